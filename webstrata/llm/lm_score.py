"""Language-model scores from log-frequency Bloom filters.

Training counts every token and every pair of neighbours of all training texts. Counts
of pairs go into Bloom filters as levels: a pair of level q is inserted q times, as
(pair, 1) to (pair, q), and a lookup probes (pair, 1), (pair, 2), ... until one is
missing. Filters are sized by what they hold, so the model grows with the corpus; two
kinds of them keep what a worker holds within bounds at any size:

- the head, of fixed size, has the most frequent pairs and is broadcast to all workers;
- parts, by hash, have all pairs, about `part_tokens` tokens' worth each. A text's
  pairs that the head doesn't know go to the tasks of their parts, each once per text
  in packed rows, and are probed there. Whatever is frequent is in the head, so no part
  gets more than its share.

A pair whose second token is outside the broadcast table of `unigrams` exact counts
lies in the part of that token, where the token's exact count is too.

The score is log10 P(text), P a bigram model: (c(v,w) + mu * p(w)) / (c(v) + mu), with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); a text begins with an end, so c(v) is the
number of pairs that begin with v as well. Counts of tokens are exact, so over all words
and one unknown the probabilities sum to one but for the rounding of pair counts above
ten and for what false positives add. The logarithm is taken apart: log10 p(w) +
log10(mu / (c(v) + mu)) is a sum over tokens, and log10(1 + c(v,w) / (mu * p(w))), the
gain of a pair, is 0 for pairs not seen in training. The base score needs exact counts
of tokens alone and comes the same way.

Tokens are words between white space, ASCII letters in lower case, then one end per
text. Texts are told apart by 128 bits of hash: copies share one score, and a task that
runs again gives the same. Defined results: null and empty texts have the end alone; a
null key is held out or not as the caller's condition says; equal rows each get their
score; with no training text every token is unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm._io import most_frequent, stored
from webstrata.llm._text import LOWER, SPACED, Counts, column, flat, look_up, mix, slices, tidy, word_hashes, words

END = np.uint64(0x5EED0FE4D0FE4D01)
ADDED = 0.1
MU = 1000.0
_BIGRAM = np.uint64(0xA24BAED4963EE407)
#: Tokens whose pairs are counted at once.
RUN = 1 << 21
#: Rows between tasks: filters and exact counts of a part come before the probes.
ROWS = "part int, kind int, a binary, b binary"
FILTER, TOKENS, OWN, NEAR, FAR, HEAD = range(6)
#: Bits that stand for a pair inside a part; bits and hashes per entry of a part's filter.
KEY_BITS, PER_ENTRY, N_HASHES = 40, 12, 5
#: Pairs of fewer occurrences are never broadcast.
OFTEN = 8
#: Ratios of probabilities travel as 16 bits of their logarithm.
FINE, SHIFT = 1000.0, 16.0


def thresholds(ratio: float = 1.2, most: float = 1e15) -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... and later each `ratio` times the last."""
    out = [1.0]
    while out[-1] < most:
        out.append(float(max(out[-1] + 1, int(out[-1] * ratio))))
    return np.array(out)


LEVELS = thresholds()
#: What a level stands for: the middle of its counts.
MEANS = np.concatenate([[0.0], np.append((LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1])])


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts as the filter would give them."""
    return MEANS[np.searchsorted(LEVELS, counts, "right")]


class LogBloom:
    """Quantised counts in a Bloom filter of n_bits bits, fewer than 2**32, with n_hashes bits per entry."""

    def __init__(self, n_bits: int = 1 << 28, n_hashes: int = 3, bits: np.ndarray | None = None):
        self.n_bits, self.n_hashes = n_bits, n_hashes
        self.bits = np.zeros(-(-n_bits // 8), np.uint8) if bits is None else bits

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
        with np.errstate(over="ignore"):
            a = mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
            b = (a >> half) | np.uint64(1)
            for i in range(self.n_hashes):
                yield (((a + np.uint64(i) * b) & low) * np.uint64(self.n_bits)) >> half

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        level = np.searchsorted(LEVELS, counts, "right")
        j = 1
        while len(keys):
            for at in self._places(keys, j):
                np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            j += 1
            keep = level >= j
            keys, level = keys[keep], level[keep]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Counts as their levels stand for them; 0 where the first probe fails."""
        level = np.zeros(len(keys), np.int64)
        on, j = np.arange(len(keys)), 1
        while len(on) and j <= len(LEVELS):
            # a key that misses its first bit is not probed for the others
            left = on
            for at in self._places(keys[on], j):
                if len(left) < len(on):
                    at = at[np.searchsorted(on, left)]
                left = left[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            on = left
            level[on] = j
            j += 1
        return MEANS[level]


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * _BIGRAM + w)


@dataclass
class Model:
    """What training gives.

    top, top_n: exact counts of the most frequent tokens, sorted by hash. head: a filter
    with the most frequent pairs. Both are broadcast. parts: (part, kind, a, b), the
    filter of each part and the exact counts of its tokens outside top.
    """

    parts: DataFrame
    n_parts: int
    n: int
    v: int
    top: np.ndarray
    top_n: np.ndarray
    head: LogBloom


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, the text of each, and the number of each text's tokens."""
    data, offs = flat(texts)
    data = LOWER[data]
    s, e, by = words(data, offs, SPACED)
    n_docs = len(texts)
    h = np.empty(len(s) + n_docs, np.uint64)
    ends = by[1:] + np.arange(n_docs)
    is_end = np.zeros(len(h), bool)
    is_end[ends] = True
    h[is_end] = END
    h[~is_end] = word_hashes(data, s, e)
    size = np.diff(by) + 1
    return h, np.repeat(np.arange(n_docs), size), size


def _top(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows with the largest counts, or a few less, sorted by hash."""
    got = most_frequent(table, n).toArrow().combine_chunks()
    h, c = np.asarray(got.column("h")).view(np.uint64), np.asarray(got.column("n"))
    order = np.argsort(h)
    return h[order], c[order]


def _packed(x: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of whole numbers, all first bytes first: upper ones are mostly alike and compress."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(raw: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """n numbers, and the bytes after them."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.view(np.uint64).ravel(), raw[n * width :]


def _place(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key, and the lower bits that stand for it there."""
    return ((keys >> np.uint64(KEY_BITS)) % np.uint64(n_parts)).astype(np.int64), keys & np.uint64((1 << KEY_BITS) - 1)


def _whole(part: int, low: np.ndarray) -> np.ndarray:
    """Of a pair in a part a key for all parts."""
    with np.errstate(over="ignore"):
        return mix((np.uint64(part) << np.uint64(KEY_BITS)) + low)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of each run of a sorted array."""
    cut = np.flatnonzero(np.diff(part)) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        if j > i:
            yield int(part[i]), i, j


def _rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    part, kind, a, b = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["part", "kind", "a", "b"])


def _batched(rows: list[tuple[int, int, bytes, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3])
        if size > most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


class _Merged:
    """Counts of the pairs of one part, near and far ones, merged some at a time."""

    def __init__(self, part: int):
        self.part, self.held, self.size = part, [], 0

    def add(self, kind: int, raw: bytes, most: int = 1 << 19) -> None:
        data = np.frombuffer(raw, np.uint8)
        n = int(data[:8].view(np.int64)[0])
        gaps, rest = _unpacked(data[8:], n, 5)
        counts, _ = _unpacked(rest, n, 4)
        # near and far ones are told apart by one more bit
        self.held.append(((np.cumsum(gaps) << np.uint64(1)) | np.uint64(kind == FAR), counts.astype(np.int64)))
        self.size += n
        # what is merged already is merged again when as much has come
        if self.size > max(most, len(self.held[0][0])):
            self._merge()

    def _merge(self) -> None:
        keys, counts = (np.concatenate([x[i] for x in self.held]) for i in range(2))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.held, self.size = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)], 0

    def filter(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """The filter of the part, sized by what it holds, and the pairs that may be among the most frequent."""
        if not self.held:
            return
        self._merge()
        (keys, counts), self.held = self.held[0], []
        low, near = keys >> np.uint64(1), (keys & np.uint64(1)) == 0
        levels = np.searchsorted(LEVELS, counts, "right")
        n_bits = max(64, min((1 << 32) - 8, PER_ENTRY * int(levels.sum())) + 7 & ~7)
        bloom = LogBloom(n_bits, N_HASHES)
        marked = np.zeros(n_bits, bool)
        for begin in range(0, len(low), 1 << 18):
            j, on, depth = 1, low[begin : begin + (1 << 18)], levels[begin : begin + (1 << 18)]
            while len(on):
                for at in bloom._places(on, j):
                    marked[at] = True
                j += 1
                on, depth = on[depth >= j], depth[depth >= j]
        yield self.part, FILTER, np.packbits(marked, bitorder="little").tobytes(), b""
        del marked
        often = near & (counts >= OFTEN)
        yield self.part, HEAD, _whole(self.part, low[often]).tobytes(), counts[often].astype(np.int64).tobytes()
        tidy()


def train(docs: DataFrame, *, text: str = "text", unigrams: int = 1 << 20, bigrams: int = 1 << 21, log_bits: int = 28, held: int = 1 << 20, part_tokens: int = 1 << 22, least_parts: int = 16) -> Model:
    """Counts over all rows given; two passes. `unigrams`, `bigrams` and `log_bits` say what is broadcast, `part_tokens` how many tokens a part has."""
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counts()
        for batch in batches:
            for part in slices(batch, "text"):
                got.add(*np.unique(tokens(part.column(0))[0], return_counts=True))
                if len(got) > held:
                    yield from got.drain()
        yield from got.drain()

    counts = stored(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_parts = max(least_parts, -(-n // part_tokens))
    top, top_n = _top(counts, unigrams)
    known = spark.sparkContext.broadcast(top)

    def counted(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        second = np.concatenate(gathered)
        # each part is whole texts, so the token before its first one is an end
        keys, at, num = np.unique(bigram_key(np.concatenate([[END], second[:-1]]), second), return_index=True, return_counts=True)
        second = second[at]
        near = look_up(known.value, second)[1]
        place, low = _place(keys, n_parts)
        place = np.where(near, place, _place(second, n_parts)[0])
        for kind, of in ((NEAR, near), (FAR, ~near)):
            p, k, c = place[of], low[of], num[of]
            order = np.lexsort((k, p))
            p, k, c = p[order], k[order], c[order]
            yield from _batched([(part, kind, np.int64(j - i).tobytes() + _packed(np.diff(k[i:j], prepend=np.uint64(0)), 5) + _packed(c[i:j], 4), b"") for part, i, j in _runs(p)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                gathered.append(tokens(part.column(0))[0])
                size += len(gathered[-1])
                if size > RUN:
                    yield from counted(gathered)
                    gathered, size = [], 0
        if size:
            yield from counted(gathered)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Merged | None = None
        for batch in batches:
            for part, kind, raw in zip(column(batch, "part").to_pylist(), column(batch, "kind").to_pylist(), column(batch, "a"), strict=True):
                if own is None or own.part != part:
                    if own is not None:
                        yield _rows(list(own.filter()))
                    own = _Merged(part)
                own.add(kind, raw.as_py())
        if own is not None:
            yield _rows(list(own.filter()))

    dealt = texts.mapInArrow(pairs, ROWS).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part")
    built = stored(dealt.mapInArrow(merged, ROWS))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = np.asarray(column(batch, "h")).view(np.uint64), np.asarray(column(batch, "n"))
            tail = ~look_up(known.value, h)[1]
            h, c = h[tail], c[tail]
            place = _place(h, n_parts)[0]
            order = np.lexsort((h, place))
            h, c, place = h[order], c[order], place[order]
            yield from _batched([(part, TOKENS, h[i:j].tobytes(), c[i:j].astype(np.int64).tobytes()) for part, i, j in _runs(place)])

    parts = built.where(f"kind = {FILTER}").unionByName(counts.mapInArrow(rest, ROWS))
    return Model(parts, n_parts, n, v, top, top_n, _head(built.where(f"kind = {HEAD}"), bigrams, log_bits))


def _head(candidates: DataFrame, most: int, log_bits: int) -> LogBloom:
    """A filter with the most frequent pairs, at most `most`: those of the highest levels that fit."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in column(batch, "b"):
                level, n = np.unique(np.searchsorted(LEVELS, np.frombuffer(raw.as_py(), np.int64), "right"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], ["level", "n"])

    per = candidates.mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    total, least = 0, len(LEVELS) + 1
    for r in sorted(per, key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        least = r["level"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(column(batch, "a"), column(batch, "b"), strict=True):
                h, n = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
                on = np.searchsorted(LEVELS, n, "right") >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(n[on])], ["h", "n"])

    got = candidates.mapInArrow(kept, "h long, n long").toArrow().combine_chunks()
    bloom = LogBloom(1 << log_bits)
    for at in range(0, got.num_rows, 1 << 18):
        bloom.add(np.asarray(got.column("h"))[at : at + (1 << 18)].view(np.uint64), np.asarray(got.column("n"))[at : at + (1 << 18)])
    return bloom


def _token_part(c: np.ndarray, under: float) -> np.ndarray:
    """What a token of count c adds to the score, as second and as first of a pair."""
    return np.log10((c + ADDED) / under) + np.log10(MU / (c + MU))


def _ratio(c1: np.ndarray, under: float) -> np.ndarray:
    """1 / (mu * p(w)) of a token of count c1."""
    return under / (MU * (c1 + ADDED))


def _sums(batch: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"t1": np.int64, "t2": np.int64, "copies": np.int64, "n_tokens": np.int64, "n_known": np.int64, "base": np.float64, "score": np.float64}
    n = len(batch["t1"])
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(batch[k]).astype(t) if k in batch else np.zeros(n, t)) for k, t in kinds.items()], list(kinds))


class _Prober:
    """One part: its filter, its exact counts, and the probes that come to it."""

    def __init__(self, part: int, under: float):
        self.part, self.under, self.bloom, self.held = part, under, None, []
        self.h = self.c = None

    def take(self, kind: int, a: bytes, b: bytes) -> pa.RecordBatch | None:
        if kind == FILTER:
            bits = np.frombuffer(a, np.uint8)
            self.bloom = LogBloom(8 * len(bits), N_HASHES, bits)
            return None
        if kind == TOKENS:
            self.held.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
            return None
        if self.h is None:
            self.h, self.c = (np.concatenate([x[i] for x in self.held]) if self.held else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
            order = np.argsort(self.h)
            self.h, self.c, self.held = self.h[order], self.c[order], []
        ids = np.frombuffer(a, np.int64)
        if kind == OWN:
            rows = {k: ids.reshape(4, -1)[i] for i, k in enumerate(("t1", "t2", "n_tokens", "n_known"))}
            sums = np.frombuffer(b, np.float64).reshape(2, -1)
            return _sums(rows | {"copies": np.ones(sums.shape[1]), "base": sums[0], "score": sums[1]})
        t1, t2, per = ids.reshape(3, -1)
        doc = np.repeat(np.arange(len(per)), per)
        n, raw = len(doc), np.frombuffer(b, np.uint8)
        keys, raw = _unpacked(raw, n, 5)
        freq, raw = _unpacked(raw, n, 4)
        freq = freq.astype(np.float64)
        c2 = self.bloom.get(keys) if self.bloom else np.zeros(n)
        if kind == NEAR:
            ratio = 2.0 ** (_unpacked(raw, n, 2)[0].astype(np.float64) / FINE - SHIFT)
            return _sums({"t1": t1, "t2": t2, "score": np.bincount(doc, freq * np.log10(1 + c2 * ratio), len(per))})
        second = np.frombuffer(raw.tobytes(), np.uint64)
        at, known = look_up(self.h, second)
        c1 = np.where(known, self.c[at] if len(self.c) else 0, 0)
        gain = _token_part(c1, self.under) + np.log10(1 + c2 * _ratio(c1, self.under))
        base = np.log10((c1 + ADDED) / self.under)
        sums = {k: np.bincount(doc, freq * x, len(per)) for k, x in (("n_known", known), ("base", base), ("score", gain))}
        return _sums({"t1": t1, "t2": t2} | sums)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.top, model.top_n, model.head))
    n, n_parts = model.n, model.n_parts
    under = n + ADDED * (model.v + 1)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text", F.octet_length("text"))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_n, head = shared.value
        turn = 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, doc, size = tokens(column(part, "text"))
                n_docs = part.num_rows
                t1, t2 = (np.asarray(column(part, c)) for c in ("t1", "t2"))
                kinds, inv = np.unique(h, return_inverse=True)
                at, known = look_up(top, kinds)
                exact = np.where(known, top_n[at] if len(top) else 0, 0)
                sums = [np.bincount(doc, np.where(known, x, 0.0)[inv], n_docs) for x in (np.log10((exact + ADDED) / under), _token_part(exact, under))]
                n_known = np.bincount(doc, known[inv], n_docs).astype(np.int64)
                pair, first, back = np.unique(bigram_key(np.concatenate([[END], h[:-1]]), h), return_index=True, return_inverse=True)
                second = inv[first]
                near = known[second]
                place, low = _place(pair, n_parts)
                ratio = _ratio(exact[second], under)
                c2 = np.zeros(len(pair))
                with np.errstate(over="ignore"):
                    c2[near] = head.get(mix((place[near].astype(np.uint64) << np.uint64(KEY_BITS)) + low[near]))
                sums[1] += np.bincount(doc, np.log10(1 + c2 * ratio)[back], n_docs)
                out = [(turn % n_parts, OWN, np.concatenate([t1, t2, size, n_known]).astype(np.int64).tobytes(), np.concatenate(sums).tobytes())]
                turn += 1
                place = np.where(near, place, _place(kinds[second], n_parts)[0])
                code = np.clip(np.rint((np.log2(ratio) + SHIFT) * FINE), 0, 65535).astype(np.uint64)
                for kind, of in ((NEAR, near & (c2 == 0)), (FAR, ~near)):
                    on = np.flatnonzero(of[back])
                    # each pair of a text once, with its number
                    ids, freq = np.unique(doc[on] * np.int64(len(pair)) + back[on], return_counts=True)
                    d, x = ids // max(1, len(pair)), ids % max(1, len(pair))
                    order = np.argsort(place[x], kind="stable")
                    d, x, freq = d[order], x[order], freq[order]
                    for p, i, j in _runs(place[x]):
                        who, per = np.unique(d[i:j], return_counts=True)
                        y = x[i:j]
                        tail = _packed(code[y], 2) if kind == NEAR else kinds[second[y]].tobytes()
                        out.append((p, kind, np.concatenate([t1[who], t2[who], per]).astype(np.int64).tobytes(), _packed(low[y], 5) + _packed(freq[i:j], 4) + tail))
                yield from _batched(out)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Prober | None = None
        for batch in batches:
            for part, kind, a, b in zip(column(batch, "part").to_pylist(), column(batch, "kind").to_pylist(), column(batch, "a"), column(batch, "b"), strict=True):
                if own is None or own.part != part:
                    own = _Prober(part, under)
                if (got := own.take(kind, a.as_py(), b.as_py())) is not None:
                    yield got

    probes = rows.select("text", "t1", "t2").mapInArrow(scan, ROWS)
    met = probes.unionByName(model.parts.select("part", "kind", "a", "b")).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "kind")
    found = met.mapInArrow(probe, "t1 long, t2 long, copies long, n_tokens long, n_known long, base double, score double")
    # copies of a text have sent their probes each; all sums are divided by their number
    sums = found.groupBy("t1", "t2").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")])
    each = [F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")] + [(F.col(c) / F.col("copies")).alias(d) for c, d in (("base", "base_score"), ("score", "score"))]
    texts = stored(sums.select("t1", "t2", *each))
    out = rows.select("key", "t1", "t2").join(texts, ["t1", "t2"]).withColumn("train_tokens", F.lit(n).cast("long"))
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out(key: Column, mod: int = 10, is_: int = 0) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod == is_
