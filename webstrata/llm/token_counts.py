"""Token counts without token ids: pieces once per distinct pre-token, joined to each document's pre-token counts.

1. Every text is cut into pre-tokens; the distinct ones of all documents are
   gathered with their counts.
2. The tokenizer counts the pieces of each distinct pre-token, once.
3. Each document's pre-token counts meet these numbers: the `frequent` most common
   pre-tokens, a bounded table, are broadcast; all others are joined by hash.

Cutting is vectorised over code points below U+0250, if the tokenizer cuts a set of
probes in the same way; texts with any other character, or with a special string, and
all texts of a tokenizer with another rule are cut by its own normalizer and
pre-tokenizer. Pre-tokens are keyed by a 64-bit hash, texts by 128 bits, so copies
share one count and a task that runs again gives the same.

Defined results: a null or empty text has no bytes and no tokens; a special string
in a text counts as one token; equal rows each get their result. Other columns stay
out of the result unless asked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._io import most_frequent, stored
from webstrata.llm._text import column, flat, list_array, look_up, slices, word_hashes

PLAIN = 0x250
# The contractions that the tokenizer's pattern splits off, in its order.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(PLAIN, ODD, np.uint8), np.arange(PLAIN, dtype=np.uint32)
    for c in range(PLAIN):
        ch = chr(c)
        if ch in " \t\n\r":
            kind[c] = SPACE
        elif c < 0x21 or 0x7F <= c <= 0xA0 or c in (0xAD, 0x130):
            continue
        else:
            cat = unicodedata.category(ch)[0]
            kind[c] = LETTER if cat == "L" else NUMBER if cat == "N" else OTHER
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
            else:
                kind[c] = ODD
            if low[c] >= PLAIN:
                kind[c] = ODD
    return kind, low


KIND, LOW = _classes()


def cut_plain(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-cased plain code points; none crosses an offset."""
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    kind = KIND[cps]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    new[offs[(offs > 0) & (offs < n)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    # an apostrophe that is a run of its own takes the contraction that follows it
    quote = np.flatnonzero((ends - starts == 1) & (cps[starts] == ord("'")))
    quote = quote[quote + 1 < len(starts)]
    quote = quote[(starts[quote + 1] == ends[quote]) & (kind[starts[np.minimum(quote + 1, len(starts) - 1)]] == LETTER)]
    inner = np.zeros(n + 1, bool)
    inner[offs[(offs > 0) & (offs < n)]] = True
    quote = quote[~inner[ends[quote]]]
    if len(quote):
        size = ends[quote + 1] - starts[quote + 1]
        a = cps[starts[quote + 1]]
        b = np.where(size > 1, cps[np.minimum(starts[quote + 1] + 1, n - 1)], 0)
        takes = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            hit = (takes == 0) & (a == ord(c[1]))
            if len(c) == 3:
                hit &= b == ord(c[2])
            takes[hit] = len(c) - 1
        quote, takes = quote[takes > 0], takes[takes > 0]
        ends[quote] += takes
        starts[quote + 1] += takes
        full = starts < ends
        starts, ends = starts[full], ends[full]
    return starts, ends


def _probes() -> list[str]:
    """Plain texts in which every plain character stands beside each kind, and all contractions."""
    plain = [chr(c) for c in np.flatnonzero(KIND != ODD)]
    around = [f"a{c}A1{c}2 {c}{c}. {c}" for c in plain]
    return [*around, *(f"x{c}y {c.upper()} {c}{c} '{c}" for c in CONTRACTIONS), "", " ", "It's  12345\tA--b\n''", "".join(plain)]


class Cutter:
    """Cuts texts into pre-tokens as the tokenizer in a file does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = all(self._agrees(x) for x in _probes())

    def _agrees(self, text: str) -> bool:
        """Whether the vectorised rule cuts a plain text as the tokenizer does."""
        cps = LOW[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        s, e = cut_plain(cps, np.array([0, len(cps)]))
        return [cps[a:b].astype(np.uint32).tobytes().decode("utf-32-le") for a, b in zip(s, e, strict=True)] == self._own(text)[0]

    def _own(self, text: str) -> tuple[list[str], int]:
        pieces, n = [text], 0
        for s in sorted(self.special, key=len, reverse=True):
            nxt = []
            for p in pieces:
                got = p.split(s)
                n += len(got) - 1
                nxt += got
            pieces = nxt
        out = []
        for p in pieces:
            norm = self.tok.normalizer.normalize_str(p) if self.tok.normalizer else p
            out += [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out, n

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, starts, ends and document of each pre-token, and special strings per document."""
        data, boffs = flat(texts)
        raw = data.tobytes()
        cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        offs = lead[boffs]
        n_docs, special = len(texts), np.zeros(len(texts), np.int64)
        odd = (cps >= PLAIN) | (KIND[np.minimum(cps, PLAIN - 1)] == ODD)
        before = np.concatenate([[0], np.cumsum(odd)])
        slow = (before[offs[1:]] > before[offs[:-1]]) | (not self.plain)
        if any(s.encode() in raw for s in self.special):
            slow |= np.array([any(s.encode() in raw[a:b] for s in self.special) for a, b in zip(boffs[:-1], boffs[1:], strict=True)])
        if not slow.any():
            low = LOW[cps]
            s, e = cut_plain(low, offs)
            return low, s, e, np.searchsorted(offs, s, "right") - 1, special
        parts, ss, es, ds, at = [], [], [], [], 0
        for i in range(n_docs):
            if slow[i]:
                toks, special[i] = self._own(raw[boffs[i] : boffs[i + 1]].decode())
                own = np.frombuffer("".join(toks).encode("utf-32-le"), np.uint32)
                e = np.cumsum([len(t) for t in toks], dtype=np.int64)
                s = e - np.array([len(t) for t in toks], np.int64)
            else:
                own = LOW[cps[offs[i] : offs[i + 1]]]
                s, e = cut_plain(own, np.array([0, len(own)]))
            parts.append(own)
            ss.append(s + at)
            es.append(e + at)
            ds.append(np.full(len(s), i))
            at += len(own)
        return np.concatenate(parts), np.concatenate(ss).astype(np.int64), np.concatenate(es).astype(np.int64), np.concatenate(ds), special


_CUTTERS: dict[str, Cutter] = {}


def _cutter(path: str) -> Cutter:
    if path not in _CUTTERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CUTTERS[path] = Cutter(path)
    return _CUTTERS[path]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def distinct_pretokens(docs: DataFrame, path: str, *, text: str = "text", held: int = 1 << 20) -> DataFrame:
    """`h`, `token`, `n`: every distinct pre-token with its count over all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(path)
        keys, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def out() -> Iterator[pa.RecordBatch]:
            names = dict(new)
            order = [names[int(k)] for k in keys]
            for at in range(0, len(keys), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys[at:to])), pa.array(order[at:to], pa.string()), pa.array(counts[at:to])], ["h", "token", "n"])

        for batch in batches:
            for part in slices(batch, text):
                cps, s, e, _, _ = cutter.cut(column(part, text))
                h, first, n = np.unique(word_hashes(cps, s, e), return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                counts[at[known]] += n[known]
                fresh = np.flatnonzero(~known)
                new += [(int(h[i]), cps[s[first[i]] : e[first[i]]].astype(np.uint32).tobytes().decode("utf-32-le")) for i in fresh]
                merged = np.concatenate([keys, h[fresh]])
                order = np.argsort(merged, kind="stable")
                keys, counts = merged[order], np.concatenate([counts, n[fresh]])[order]
                if len(keys) >= held:
                    yield from out()
                    keys, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        yield from out()

    found = docs.select(F.col(f"`{text}`")).mapInArrow(scan, "h long, token string, n long")
    return found.groupBy("h", "token").agg(F.sum("n").alias("n"))


def count_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """`h`, `n`, `pieces`: the tokenizer's pieces of each pre-token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _cutter(path).tok
        for batch in batches:
            names = column(batch, "token").to_pylist()
            pieces: list[int] = []
            for at in range(0, len(names), 4096):
                pieces += [len(x) for x in tok.encode_batch_fast(names[at : at + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([column(batch, "h"), column(batch, "n"), pa.array(pieces, pa.int32())], ["h", "n", "pieces"])

    return tokens.mapInArrow(scan, "h long, n long, pieces int")


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", frequent: int = 1 << 18) -> DataFrame:
    """`key`, `n_bytes`, `n_tokens` of every row. frequent: entries of the broadcast table, 12 bytes each."""
    spark = docs.sparkSession
    table = stored(count_pieces(distinct_pretokens(docs, path, text=text), path))
    top = most_frequent(table, frequent).select("h", "pieces").toArrow().combine_chunks()
    th, tp = np.asarray(top.column("h")), np.asarray(top.column("pieces"))
    order = np.argsort(th)
    shared = spark.sparkContext.broadcast((th[order], tp[order].astype(np.int32)))
    del top, th, tp

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(path)
        th, tp = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = column(part, "text")
                cps, s, e, doc, special = cutter.cut(texts)
                h = _signed(word_hashes(cps, s, e))
                at, known = look_up(th, h)
                base = np.bincount(doc[known], tp[at[known]], len(texts)).astype(np.int64) + special
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((h[rest], doc[rest]))]
                d, x = doc[rest], h[rest]
                new = np.ones(len(rest), bool)
                new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
                first = np.flatnonzero(new)
                freq = np.diff(np.append(first, len(rest)))
                # a row of its own for each text; its hash spreads it and its count of 0 adds nothing
                hs, fs, ds = np.concatenate([np.asarray(column(part, "t1")), x[first]]), np.concatenate([np.zeros(len(texts), np.int64), freq]), np.concatenate([np.arange(len(texts)), d[first]])
                sort = np.argsort(ds, kind="stable")
                rows = pa.StructArray.from_arrays([pa.array(hs[sort], pa.int64()), pa.array(fs[sort], pa.int64())], ["h", "freq"])
                yield pa.RecordBatch.from_arrays([column(part, "t1"), column(part, "t2"), pa.array(base), list_array(rows, np.bincount(ds, minlength=len(texts)))], ["t1", "t2", "base", "rest"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text", F.octet_length("text"))})
    per = rows.select("text", "t1", "t2").mapInArrow(scan, "t1 long, t2 long, base long, rest array<struct<h:long,freq:long>>")
    found = per.select("t1", "t2", "base", F.explode("rest").alias("r")).select("t1", "t2", F.when(F.col("r.freq") == 0, F.col("base")).alias("base"), F.col("r.h").alias("h"), F.col("r.freq").alias("freq"))
    met = found.join(table.select("h", "pieces"), "h", "left")
    # copies of a text send their counts each; the sum is divided by their number
    total = F.sum(F.coalesce("base", F.lit(0)) + F.col("freq") * F.coalesce("pieces", F.lit(0)))
    texts = stored(met.groupBy("t1", "t2").agg(total.alias("total"), F.count_if(F.col("freq") == 0).alias("copies")).select("t1", "t2", F.expr("total div copies").alias("n_tokens")))
    return rows.select("key", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes")).join(texts, ["t1", "t2"]).select(F.col("key").alias(key), "n_bytes", "n_tokens")
