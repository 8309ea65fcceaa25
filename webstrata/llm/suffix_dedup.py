"""Removal of repeated strings by suffix arrays built with external induced sorting.

Every byte covered by a string of `width` bytes that starts at another place too is
removed. Such strings are found in shards:

1. Every window of `width` bytes has an anchor, the least of the hashes of its
   `gram`-byte strings. Neighbouring windows with one anchor form a stretch. Equal
   windows have equal anchors, so a stretch whose anchor is found once in all texts
   holds no repeat. A bitmap of fixed size marks the anchors found more often; it
   only saves work.
2. A stretch with the same bytes as another one repeats as a whole.
3. All other stretches that share an anchor go, by anchor, to the shard of that
   anchor, one copy of each, and a suffix array with common-prefix values is built
   there (:mod:`webstrata.llm._induced`): windows whose common prefix with a
   neighbour reaches `width` repeat. A shard may be larger than memory: beyond a
   budget of symbols all that is as long as the shard is on disk, in a scratch folder
   of the task, lost and made again with the task.
4. What repeats is gathered per text, by a hash of the whole text; equal texts have
   equal repeats.

Texts are compared by 128-bit hashes, stretches by an anchor and a hash of 64 bits
each. Defined results: null and empty texts have no bytes; texts shorter than
`width` are kept; a repeated row repeats all its strings; where the bytes left are
no UTF-8 they are bytes still. No other column matters.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._induced import Spool, descending
from webstrata.llm._io import stored
from webstrata.llm._text import Counts, column, flat, list_array, mix, powers, slices

WIDTH, GRAM = 200, 64
#: Bitmaps of anchors, places and texts: 16, 8 and 8 MB at any size.
ANCHOR_BITS, PLACE_BITS, TEXT_BITS = 27, 26, 26
PIECE, SLICE = 1 << 19, 1 << 20
SEEN = 1 << 16
#: Places of a shard that are looked at together.
STEP = 1 << 18


def _slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by blocks of w: the end of one and the beginning of the next."""
    n = len(v) - w + 1
    full = np.full(len(v) + -len(v) % w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    ahead = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(full[::-1].reshape(-1, w), axis=1).ravel()[::-1]
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _pieces(offs: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most PIECE bytes, or pieces of one longer text that overlap by width - 1."""
    i, n = 0, len(offs) - 1
    while i < n:
        if offs[i + 1] - offs[i] > PIECE:
            for at in range(int(offs[i]), int(offs[i + 1]) - width + 1, PIECE):
                yield at, min(at + PIECE + width - 1, int(offs[i + 1]))
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
            yield int(offs[i]), int(offs[j])
            i = j


def stretches(data: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Stretches of all texts: text, start in it, windows, hash of the anchor, hash of the bytes."""
    parts: list[tuple[np.ndarray, ...]] = []
    low = np.uint64((1 << 24) - 1)
    with np.errstate(over="ignore"):
        for a, b in _pieces(offs, width):
            n = b - a - width + 1
            if n <= 0:
                continue
            up, down = powers(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.multiply(data[a:b] + np.uint64(1), up[: b - a], out=sums[1:])
            np.cumsum(sums, out=sums)
            grams = sums[gram:] - sums[:-gram]
            grams *= down[: len(grams)]
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
            key = grams & ~low
            key |= np.arange(len(grams), dtype=np.uint64)
            least = _slide_min(key, width - gram + 1)
            # windows that lie within one text: for each text a run of starts
            first_doc, last_doc = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
            docs = np.arange(first_doc, last_doc)
            lo, hi = np.maximum(offs[docs], a) - a, np.minimum(offs[docs + 1], b) - a - width + 1
            docs, lo, hi = docs[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(docs):
                continue
            change = np.flatnonzero(least[1:] != least[:-1]) + 1
            of = np.searchsorted(lo, change, "right") - 1
            ok = (of >= 0) & (change < hi[np.maximum(of, 0)]) & (change > lo[np.maximum(of, 0)])
            begin = np.concatenate([lo, change[ok]])
            doc = np.concatenate([np.arange(len(lo)), of[ok]])
            order = np.argsort(begin, kind="stable")
            begin, doc = begin[order], doc[order]
            end = np.append(begin[1:], hi[-1])
            end = np.minimum(end, hi[doc])
            windows = end - begin
            stop = end + width - 1
            body = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
            parts.append((docs[doc], begin + a - offs[docs[doc]], windows, mix(grams[(least[begin] & low).astype(np.int64)]), body))
    names = ("doc", "start", "windows", "anchor", "body")
    if not parts:
        return {k: np.zeros(0, np.uint64 if k in ("anchor", "body") else np.int64) for k in names}
    return {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(names)}


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, marked by the upper bits of the hashes; `hashes` has one column of longs."""
    p = hashes.select(F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits).alias("p"))
    got = p.groupBy((F.col("p") / 32768).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("bits")).toArrow().combine_chunks()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, b in zip(got.column("k").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(b, np.uint8)
    return out


def _in_map(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = (h >> np.uint64(64 - (len(marks).bit_length() + 2))).astype(np.int64)
    return (marks[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


def sort_shard(batches: Iterator[pa.RecordBatch], width: int, in_memory: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the stretches of a task: rows (t1, t2, start, length) of what they cover.

    The text, the stretches' keys, the suffixes and a mark for every place are in files;
    at most `in_memory` symbols are sorted, and as many tuples queued, in memory.
    """
    with tempfile.TemporaryDirectory() as tmp:
        symbols, ends = Spool(tmp, np.uint16), Spool(tmp, np.int64)
        keys = {c: Spool(tmp, np.int64) for c in ("t1", "t2", "start")}
        for batch in batches:
            data, offs = flat(column(batch, "bytes"))
            # a 0 ends each stretch, other symbols are moved up by one
            size = np.diff(offs)
            out = np.zeros(len(data) + batch.num_rows, np.uint16)
            out[np.arange(len(data)) + np.repeat(np.arange(batch.num_rows), size)] = data.astype(np.uint16) + 1
            ends.append(symbols.n + np.cumsum(size + 1))
            symbols.append(out)
            for c, f in keys.items():
                f.append(np.asarray(column(batch, c)))
        n = symbols.n
        if not n:
            return
        suffixes, prefixes = descending(symbols.array(), width, tmp, memory=in_memory, in_memory=in_memory)
        # a place repeats if its suffix shares `width` symbols with the one before or after it
        marked = np.memmap(f"{tmp}/marked", bool, "w+", shape=(n,))
        place, lcp = suffixes.array(), prefixes.array()
        for at in range(0, n, STEP):
            long = np.asarray(lcp[at : at + STEP + 1]) >= width
            long[0] &= at > 0
            here = long[:STEP] | (np.append(long[1:], False)[: len(long[:STEP])])
            marked[np.asarray(place[at : at + STEP])[here]] = True
        stop, (t1, t2, start) = ends.array(), (f.array() for f in keys.values())
        for at in range(0, n, STEP):
            found = np.flatnonzero(marked[at : at + STEP]) + at
            of = np.searchsorted(stop, found, "right")
            begin = np.where(of > 0, stop[np.maximum(of - 1, 0)], 0)
            ok = found + width < stop[of]
            of, inside = of[ok], (found - begin)[ok]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            run, o = np.diff(np.append(first, len(of))), of[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(t1[o])), pa.array(np.asarray(t2[o])), pa.array(start[o] + inside[first]), pa.array(run + width - 1)], ["t1", "t2", "start", "length"])


def repeats(docs: DataFrame, *, text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = 1 << 20) -> DataFrame:
    """(t1, t2, spans): for each text that holds a repeat, by the text's hash, the maximal repeated runs (start, length)."""
    spark = docs.sparkSession
    texts = with_ids(docs.select(F.col(f"`{text}`").alias("text")), "text").where(F.octet_length("text") >= width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counts()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = stretches(*flat(column(part, "text")), width, gram)
                got.add(*np.unique(s["anchor"], return_counts=True))
                if len(got) > 1 << 20:
                    yield from got.drain()
        yield from got.drain()

    often = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    marks = spark.sparkContext.broadcast(_bitmap(often, ANCHOR_BITS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = stretches(*flat(column(part, "text")), width, gram)
                keep = _in_map(marks.value, s["anchor"])
                d = s["doc"][keep]
                if not len(d):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["anchor"][keep].view(np.int64)), pa.array(s["body"][keep].view(np.int64)), pa.array(np.asarray(column(part, "t1"))[d]), pa.array(np.asarray(column(part, "t2"))[d]), pa.array(s["start"][keep].astype(np.int64)), pa.array(s["windows"][keep].astype(np.int32))],
                    ["anchor", "body", "t1", "t2", "start", "windows"],
                )

    found = stored(texts.mapInArrow(find, "anchor long, body long, t1 long, t2 long, start long, windows int"))
    bodies = found.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "start")).alias("one"))
    bodies = stored(bodies)
    # whole stretches that repeat
    twice = bodies.where("n > 1").select("anchor", "body")
    whole = found.join(twice, ["anchor", "body"]).select("t1", "t2", "start", (F.col("windows") + (width - 1)).cast("long").alias("length"))
    # anchors with different stretches: one copy of each goes to the anchor's shard
    mixed = bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    ones = stored(bodies.join(mixed, "anchor").select("anchor", "one.*"))
    refs = spark.sparkContext.broadcast(_bitmap(ones.select(_ref_col()), PLACE_BITS))
    n_bytes = ones.count() * (width + 68)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_bytes // shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts that the task has cut already; forgotten from time to time, as this only saves work
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                fresh = []
                for tid in zip(column(part, "t1").to_pylist(), column(part, "t2").to_pylist(), strict=True):
                    fresh.append(tid not in done)
                    done.add(tid)
                if len(done) > SEEN:
                    done.clear()
                part = part.filter(pa.array(fresh))
                data, offs = flat(column(part, "text"))
                s = stretches(data, offs, width, gram)
                t1, t2 = np.asarray(column(part, "t1"))[s["doc"]], np.asarray(column(part, "t2"))[s["doc"]]
                keep = np.flatnonzero(_in_map(marks.value, s["anchor"]))
                keep = keep[_in_map(refs.value, _ref(t1[keep], s["start"][keep]))]
                begin = offs[s["doc"][keep]] + s["start"][keep]
                body = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + s["windows"][keep] + width - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["anchor"][keep].view(np.int64)), pa.array(t1[keep]), pa.array(t2[keep]), pa.array(s["start"][keep].astype(np.int64)), pa.array(body, pa.binary())],
                    ["anchor", "t1", "t2", "start", "bytes"],
                )

    place = ["anchor", "t1", "t2", "start"]
    # copies of a text that other tasks have cut go here
    pieces = texts.mapInArrow(cut, "anchor long, t1 long, t2 long, start long, bytes binary").join(ones, place, "left_semi").dropDuplicates(place)
    dealt = pieces.repartition(shards, "anchor")
    partly = dealt.mapInArrow(lambda b: sort_shard(b, width), "t1 long, t2 long, start long, length long")
    spans = stored(whole.unionByName(partly).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "length")).alias("spans")))
    marks.destroy()
    refs.destroy()
    return spans


def _ref(tid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The second bitmap's key of a place in a text, as :func:`_ref_col` makes it."""
    return tid.view(np.uint64) ^ (start.astype(np.uint64) << np.uint64(44))


def _ref_col():
    return F.col("t1").bitwiseXOR(F.shiftleft("start", 44))


def with_ids(docs: DataFrame, text: str) -> DataFrame:
    """t1, t2: 128 bits of hash of the text."""
    return docs.withColumns({"t1": F.xxhash64(F.col(f"`{text}`")), "t2": F.xxhash64(F.lit(7), F.col(f"`{text}`"), F.octet_length(f"`{text}`"))})


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, keep_bytes: bool = True, **options) -> DataFrame:
    """`key`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, and the bytes left as `kept`, of every row."""
    spark = docs.sparkSession
    spans = repeats(docs, text=text, width=width, **options)
    marks = spark.sparkContext.broadcast(_bitmap(spans.select("t1"), TEXT_BITS))
    rows = with_ids(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text")
    kind = rows.schema["key"].dataType.simpleString()
    fields = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes

    def out(part: pa.RecordBatch, texts: pa.Array, found: list) -> pa.RecordBatch:
        data, offs = flat(texts)
        removed, n_spans, shas, kept = [], [], [], []
        for i, rs in enumerate(found):
            body = data[offs[i] : offs[i + 1]]
            gone, n = 0, 0
            if rs:
                runs: list[list[int]] = []
                for a, size in sorted((r["start"], r["length"]) for r in rs):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], a + size)
                    else:
                        runs.append([a, a + size])
                mask = np.ones(len(body), bool)
                for a, b in runs:
                    mask[a:b] = False
                    gone += b - a
                body, n = body[mask], len(runs)
            raw = body.tobytes()
            removed.append(gone)
            n_spans.append(n)
            shas.append(hashlib.sha256(raw).hexdigest())
            kept.append(raw)
        cols = [column(part, "key"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_bytes, names + ["kept"] * keep_bytes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_in_map(marks.value, np.asarray(column(batch, "t1")).view(np.uint64))))
            for part in slices(batch, "text", SLICE):
                yield out(part, column(part, "text"), [None] * part.num_rows)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_map(marks.value, np.asarray(column(batch, "t1")).view(np.uint64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield out(part, column(part, "text"), column(part, "spans").to_pylist())

    some = rows.mapInArrow(marked, rows.schema).join(spans, ["t1", "t2"], "left").select("key", "text", "spans")
    return rows.mapInArrow(clean, fields).unionByName(some.mapInArrow(cut, fields)).withColumnRenamed("key", key)
