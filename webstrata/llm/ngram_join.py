"""Jaccard similarity join on word n-grams with adaptive prefixes that must match more than once.

All n-grams have one order: rare ones first, by counts gathered over all documents.
If two sets of sizes that fit reach the threshold, their prefixes of
size - ceil(threshold * size) + l n-grams share at least l, and at the k-th shared
one enough n-grams are left on both sides. A document gets the l of the least
estimated cost: a larger one lengthens its prefix but asks for more shared n-grams,
which pays where many documents share one n-gram each and not where they share whole
passages. A pair must share as many as the smaller l of the two. What shares enough
is verified on the whole sets.

Equal texts form one class, so copies cost one narrow row each. Links are found in
two rounds: first each class is held against one leader per shared n-gram, the class
in which it comes earliest, which is the original where there is one; then the full
join looks only at pairs of different components, as a link inside a component
cannot change it. Of an n-gram's holders those of its largest component aren't held
against each other, so a group of near copies costs a row each there too.

A pair's whole sets are only compared if their signatures allow it: one bit for each
n-gram, folded by parity into about as many bits as there are n-grams. Bits that
differ are no more than the n-grams that do.

N-grams are compared by 64-bit hashes of their words, texts by 128 bits. Estimates
come from counts that repeat inside a task; they steer the order and l, never the
result. Bitmaps of fixed size only save work.

Defined results: a text without words, or null, has an empty set and is its own
component; fewer words than n make one n-gram of them all; equal rows share a
component; a null key takes part and never is a component's id unless all its keys
are null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm._components import components
from webstrata.llm._io import free_name, most_frequent, small_batches, stored
from webstrata.llm._text import LOWER, SPACED, Counts, column, flat, list_array, look_up, mix, slices, window_hashes, word_hashes, words

MOST_MATCHES = 8
#: N-grams of more documents than this are taken to come from a shared passage.
LIGHT = 64
#: Bitmaps of rows and of n-grams: 8 and 16 MB at any size.
ROW_BITS, OFTEN_BITS = 26, 27
#: Bits by which n-grams are told apart while those found again are looked for.
COUNT_BITS = 40


def sets_of(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted, text after text, and each text's number."""
    data, offs = flat(texts)
    data = LOWER[data]
    s, e, by = words(data, offs, SPACED)
    h = word_hashes(data, s, e)
    n_docs = len(texts)
    size = np.diff(by)
    grams = window_hashes(h, n)
    left = np.repeat(by[1:], size) - np.arange(len(h))
    at = np.flatnonzero(left >= n)
    doc = np.repeat(np.arange(n_docs), size)[at]
    grams = grams[at]
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        own = np.array([window_hashes(h[by[i] : by[i + 1]], int(size[i]))[0] for i in few], np.uint64)
        doc, grams = np.concatenate([doc, few]), np.concatenate([grams, own])
        order = np.argsort(doc, kind="stable")
        doc, grams = doc[order], grams[order]
    cut = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j - i > 1:
            grams[i:j].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(doc[new], minlength=n_docs).astype(np.int64)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Of a prefix that must share one n-gram. Whole numbers avoid rounding: threshold in thousandths."""
    t = round(threshold * 1000)
    return np.where(size > 0, size - -(-t * size // 1000) + 1, 0)


def prefixes(grams: np.ndarray, sizes: np.ndarray, heavy: np.ndarray, heavy_n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix n-grams by document, their number, and each document's l.

    Cost of an l: the rows scanned, and a price for each document that may be
    verified. N-grams of many documents are taken to come from one passage, so the
    same documents share them and a larger l spares none; those of few documents
    come from different ones.
    """
    at, known = look_up(heavy, grams)
    cost = np.where(known, heavy_n[at] if len(heavy) else 0, 0).astype(np.int64)
    key = (np.minimum(cost, (1 << 16) - 1).astype(np.uint64) << np.uint64(48)) | (mix(grams) >> np.uint64(16))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.arange(len(grams))
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        if j - i > 1:
            order[i:j] = i + np.argsort(key[i:j], kind="stable")
    grams, cost = grams[order], cost[order]
    sums, light = (np.concatenate([[0], np.cumsum(x)]) for x in (cost, np.where(cost <= LIGHT, cost, 0)))
    p = prefix_length(sizes, threshold)
    best, ell = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int64)
    need = -(-round(threshold * 1000) * sizes // 1000)
    last = cost[np.minimum(starts + np.maximum(p, 1) - 1, len(cost) - 1)] if len(cost) else np.zeros(len(sizes), np.int64)
    for length in range(1, MOST_MATCHES + 1):
        fits = (p + length - 1 <= sizes) & (length <= np.maximum(need, 1))
        to = starts + np.minimum(p + length - 1, sizes)
        scan = (sums[to] - sums[starts]).astype(float)
        verified = np.where(last > LIGHT, last, 0) + (light[to] - light[starts]) / length**2
        price = scan + verified * (8 + sizes / 64.0) + length
        better = fits & (price < best)
        best[better], ell[better] = price[better], length
    take = np.minimum(p + ell - 1, sizes)
    pick = np.repeat(starts, take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    return grams[pick], take, ell


def _only(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """Rows whose `place` the bitmap marks."""
    place = np.asarray(column(batch, "place"))
    return batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, whatever the number of rows; they have one column of places below 2**bits."""
    p = F.col(places.columns[0])
    got = places.groupBy((p / 32768).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.pmod(p, F.lit(32768))).alias("bits")).toArrow().combine_chunks()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, b in zip(got.column("k").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(b, np.uint8)
    return out


def _heavy(docs: DataFrame, n: int, keep: int, reps, held: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most documents hold, as far as they repeat inside a task; `keep` at most, 16 bytes each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counts()

        def out() -> Iterator[pa.RecordBatch]:
            often = got.n > 1
            got.keys, got.n = got.keys[often], got.n[often]
            yield from got.drain()

        for batch in batches:
            for part in slices(_only(batch, reps.value), "text"):
                got.add(*np.unique(sets_of(column(part, "text"), n)[0], return_counts=True))
                if len(got) > held:
                    yield from out()
        yield from out()

    counts = stored(docs.select("text", "place").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    top = most_frequent(counts, keep).toArrow().combine_chunks()
    h, c = np.asarray(top.column("h")).view(np.uint64), np.asarray(top.column("n"))
    order = np.argsort(h)
    return h[order], c[order]


def signatures(grams: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Of each set the parity of its n-grams in the least power of two of bits that is its size or more, 64 at least."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    begin = np.cumsum(bits >> 3) - (bits >> 3)
    out = np.zeros(int((bits >> 3).sum()), np.uint8)
    at = (mix(grams + np.uint64(1)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, np.repeat(begin, sizes) + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    ends = np.concatenate([begin, [len(out)]])
    return pa.array([out[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ, the longer one folded to the size of the other: no more than n-grams that differ."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), len(x)
    while size > len(y):
        size >>= 1
        a = (a >> (8 * size)) ^ (a & ((1 << (8 * size)) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs with sizes na, nb and signatures sa, sb those that may reach the threshold."""
    t = round(threshold * 1000)
    names = ["a", "b", "a1", "a2", "b1", "b2"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(column(batch, "na")).astype(np.int64) + np.asarray(column(batch, "nb"))
            differ = [differing(x.as_py(), y.as_py()) for x, y in zip(column(batch, "sa"), column(batch, "sb"), strict=True)]
            keep = pa.array((1000 + t) * np.array(differ, np.int64) <= (1000 - t) * total)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in names], names)

    return pairs.mapInArrow(check, ", ".join(f"{c} long" for c in names))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b, texts a1 a2 and b1 b2) those whose sets reach the threshold."""
    t = round(threshold * 1000)
    left = pairs.join(sets.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("grams").alias("x")), ["a1", "a2"])
    both = left.join(sets.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("grams").alias("y")), ["b1", "b2"]).select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = part.column(2), part.column(3)
                nx, ny = np.asarray(x.value_lengths()).astype(np.int64), np.asarray(y.value_lengths()).astype(np.int64)
                row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                v = np.concatenate([np.asarray(x.flatten()), np.asarray(y.flatten())])
                order = np.lexsort((v, row))
                v, row = v[order], row[order]
                same = (v[1:] == v[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][same], minlength=len(nx))
                out.append(1000 * common >= t * (nx + ny - common))
            keep = pa.array(np.concatenate(out) if out else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def _found_again(docs: DataFrame, pick, held: int = 1 << 20) -> np.ndarray:
    """A bitmap of the places of all n-grams that `pick` gives for more than one row.

    Tasks count their own and send the upper COUNT_BITS bits of each, in sorted runs
    of differences, to the task of their range.
    """
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = min(max(1, (wanted - 1).bit_length()), OFTEN_BITS - 6)
    within = COUNT_BITS - deal

    def sent(got: Counts) -> Iterator[pa.RecordBatch]:
        # n-grams that share the upper bits are one key, as gaps must not be negative; the last bit tells
        # whether the task itself has it more than once
        upper = got.keys >> np.uint64(64 - COUNT_BITS)
        first = np.flatnonzero(np.append(True, upper[1:] != upper[:-1])) if len(upper) else np.zeros(0, np.int64)
        keys = (upper[first] << np.uint64(1)) | (np.add.reduceat(got.n, first) > 1 if len(first) else np.zeros(0, bool))
        part = (keys >> np.uint64(within + 1)).astype(np.int64)
        cut = np.searchsorted(part, np.arange((1 << deal) + 1))
        ids, blobs = [], []
        for p, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if j > i:
                gaps = np.diff(keys[i:j] & np.uint64((1 << (within + 1)) - 1), prepend=np.uint64(0))
                ids.append(p)
                blobs.append(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())
        got.__init__()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Counts()
        for batch in batches:
            for grams in pick(batch):
                got.add(*np.unique(grams, return_counts=True))
                if len(got) > held:
                    yield from sent(got)
        yield from sent(got)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, raw in zip(column(batch, "part").to_pylist(), column(batch, "keys"), strict=True):
                data = np.frombuffer(raw.as_py(), np.uint8)
                wide = np.zeros((len(data) // 6, 8), np.uint8)
                wide[:, :6] = data.reshape(6, -1).T
                parts.setdefault(part, []).append(np.cumsum(wide.view(np.uint64).ravel()))
        bits = OFTEN_BITS - deal
        for part, got in parts.items():
            keys = np.sort(np.concatenate(got))
            key = keys >> np.uint64(1)
            again = (keys & np.uint64(1)) == 1
            again[1:] |= key[1:] == key[:-1]
            marked = np.zeros(1 << bits, bool)
            marked[(key[again] >> np.uint64(within - bits)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    dealt = docs.mapInArrow(count, "part int, keys binary").repartitionById(1 << deal, F.col("part"))
    got = dealt.mapInArrow(merge, "part int, bits binary").toArrow().combine_chunks()
    size = 1 << (OFTEN_BITS - deal - 3)
    out = np.zeros(1 << (OFTEN_BITS - 3), np.uint8)
    for part, bits in zip(got.column("part").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[part * size : (part + 1) * size] = np.frombuffer(bits, np.uint8)
    return out


def similarity_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, heavy: int = 1 << 18) -> DataFrame:
    """`key`, `n_shingles`, `component_id` and `text_hash` of every row."""
    with small_batches(docs.sparkSession):  # all that runs in Python is stored there; the rows returned need none
        return _classes(docs, key, text, n, threshold, heavy)


def _classes(docs: DataFrame, key: str, text: str, n: int, threshold: float, heavy: int) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    t = round(threshold * 1000)
    # a place in the bitmap for every row: by key and text, so a class needs one of its rows only
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text", F.octet_length("text"))})
    docs = docs.withColumn("place", F.pmod(F.xxhash64("key", "t1"), F.lit(1 << ROW_BITS)))
    kind = docs.schema["key"].dataType.simpleString()
    rows = stored(docs.select("key", "t1", "t2"))
    classes = stored(rows.groupBy("t1", "t2").agg(F.min("key").alias("first")).withColumn("cid", F.monotonically_increasing_id()))
    place = F.pmod(F.xxhash64("first", "t1"), F.lit(1 << ROW_BITS))
    reps = share(_bitmap(classes.select(place.alias("p")), ROW_BITS))
    table = share(_heavy(docs, n, heavy, reps))

    # prefix n-grams found in more than one class, by a bitmap of their hashes
    def heads(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(_only(batch, reps.value), "text"):
            yield prefixes(*sets_of(column(part, "text"), n), *table.value, threshold)[0]

    often = share(_found_again(docs.select("text", "place"), heads))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(_only(batch, reps.value), "text"):
                grams, sizes = sets_of(column(part, "text"), n)
                pick, take, ell = prefixes(grams, sizes, *table.value, threshold)
                pos = np.arange(len(pick)) - np.repeat(np.cumsum(take) - take, take)
                p = (pick >> np.uint64(64 - OFTEN_BITS)).astype(np.int64)
                keep = (often.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
                of = np.repeat(np.arange(len(take)), take)[keep]
                marks = pa.StructArray.from_arrays([pa.array(pick[keep].view(np.int64)), pa.array(pos[keep].astype(np.int32))], ["gram", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [column(part, "key"), column(part, "t1"), column(part, "t2"), pa.array(sizes), pa.array(ell.astype(np.int16)), list_array(marks, np.bincount(of, minlength=len(take))), signatures(grams, sizes)],
                    ["key", "t1", "t2", "n", "ell", "marks", "sig"],
                )

    cuts = docs.select("key", "text", "t1", "t2", "place").mapInArrow(cut, f"key {kind}, t1 long, t2 long, n long, ell short, marks array<struct<gram:long,pos:int>>, sig binary")
    of = classes.select("cid", F.col("t1").alias("c1"), F.col("t2").alias("c2"), "first")
    same = (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")) & F.col("key").eqNullSafe(F.col("first"))
    cuts = stored(cuts.join(of, same).select("cid", "c1", "c2", "first", F.col("n").cast("int").alias("n"), "ell", "marks", "sig"))
    repeated = cuts.count() != classes.count()
    if repeated:  # rows that are equal in key and text
        cuts = cuts.dropDuplicates(["cid"])
    for b in (reps, table, often):
        b.destroy()
    # sums by n-gram are stored and joined back, so that Spark can split the rows of a frequent one
    marked = cuts.select("cid", "n", "ell", F.explode("marks").alias("m")).select("m.gram", "m.pos", "cid", "n", "ell")
    held = stored(marked.groupBy("gram").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least")).where("held > 1").select("gram", "least"))
    # a row whose n-gram comes too late for the smallest set that fits can't be part of a link
    small = F.greatest(F.col("least").cast("long"), F.ceil(F.lit(t) * F.col("n") / 1000))
    early = (1000 + t) * (F.col("n") - F.col("pos") + F.col("ell") - 1).cast("long") >= F.lit(t) * (F.col("n") + small)
    shared = stored(marked.join(held, "gram").where(early).select("gram", "pos", "cid", "n", "ell"))
    texts = cuts.select("cid", "c1", "c2", "first", "n", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        for e in "ab":
            pairs = pairs.join(texts.select(F.col("cid").alias(e), F.col("c1").alias(f"{e}1"), F.col("c2").alias(f"{e}2"), F.col("n").alias(f"n{e}"), F.col("sig").alias(f"s{e}")), e)
        return stored(_likely(pairs, threshold))

    def sets(pairs: DataFrame) -> DataFrame:
        """(t1, t2, grams): whole sets of the classes in pairs, and by chance of a few more."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(texts.select("cid", "first", "c1"), "cid")
        marked = share(_bitmap(needed.select(F.pmod(F.xxhash64("first", "c1"), F.lit(1 << ROW_BITS)).alias("p")), ROW_BITS))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(_only(batch, marked.value), "text"):
                    grams, sizes = sets_of(column(part, "text"), n)
                    yield pa.RecordBatch.from_arrays([column(part, "t1"), column(part, "t2"), list_array(pa.array(grams.view(np.int64)), sizes)], ["t1", "t2", "grams"])

        got = docs.select("text", "t1", "t2", "place").mapInArrow(whole, "t1 long, t2 long, grams array<long>")
        return got.dropDuplicates(["t1", "t2"]) if repeated else got

    def fits(x: str, y: str, i: str, j: str, slack: Column) -> Column:
        """Sizes that fit, and at the k-th shared n-gram enough left on both sides."""
        sized = (F.lit(t) * F.col(x) <= 1000 * F.col(y)) & (F.lit(t) * F.col(y) <= 1000 * F.col(x))
        left = F.least(F.col(x) - F.col(i), F.col(y) - F.col(j)) + slack
        return sized & ((1000 + t) * left >= F.lit(t) * (F.col(x) + F.col(y)))

    def linked(pairs: DataFrame) -> DataFrame:
        some = likely(pairs)
        return stored(_verified(some, sets(some), threshold))

    lead = F.min(F.struct("pos", "n", "cid", "ell")).alias("lead")
    leads = stored(shared.groupBy("gram").agg(lead, F.count(F.lit(1)).alias("held")).where("held > 1").select("gram", "lead"))
    led = shared.join(leads, "gram").select("cid", "n", "pos", "ell", F.col("lead.cid").alias("a"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("at"), F.col("lead.ell").alias("l"))
    led = led.where((F.col("cid") != F.col("a")) & fits("n", "m", "pos", "at", F.least("ell", "l") - 1))
    tried = stored(led.select(F.least("cid", "a").alias("a"), F.greatest("cid", "a").alias("b")).distinct())
    links = linked(tried)
    comps = components(links)
    # the full join, between components: all holders of an n-gram against those outside its largest component
    labelled = stored(shared.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    sizes = labelled.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = stored(sizes.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("gram", F.col("most.comp").alias("largest")))
    labelled = stored(labelled.join(largest, "gram"))
    x, y = (labelled.select(*[F.col(c).alias(f"{c}_{s}") for c in ("gram", "cid", "n", "pos", "ell", "comp", "largest")]) for s in "ab")
    close = fits("n_a", "n_b", "pos_a", "pos_b", F.least("ell_a", "ell_b") - 1)
    once = (F.col("comp_b") == F.col("largest_b")) | (F.col("cid_a") < F.col("cid_b"))
    met = x.where("comp_a <> largest_a").join(y, (F.col("gram_a") == F.col("gram_b")) & (F.col("comp_a") != F.col("comp_b")) & once & close)
    ends = [F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")]
    enough = met.groupBy(*ends).agg(F.count(F.lit(1)).alias("k"), F.min(F.least("ell_a", "ell_b")).alias("ell")).where("k >= ell").select("a", "b")
    comps = components(links.union(linked(stored(enough.join(tried, ["a", "b"], "left_anti")))))

    ids = stored(comps.join(texts.select(F.col("cid").alias("id"), "first"), "id").groupBy("comp").agg(F.min("first").alias("component_id")))
    members = comps.join(ids, "comp").select(F.col("id").alias("cid"), "component_id")
    final = texts.select("cid", "c1", "c2", "first", "n").join(members, "cid", "left")
    final = stored(final.select(F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("n").cast("long").alias("n"), F.coalesce("component_id", "first").alias("component_id")))
    out = rows.join(final, ["t1", "t2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("t1").alias("text_hash"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near copies: the one whose key is the component's id.

    Documents without words all stay. Of rows with the same key and text one stays;
    rows without a key stay if their whole group has none.
    """
    found = similarity_classes(docs, key=key, text=text, **options).where(F.col("component_id").eqNullSafe(F.col(f"`{key}`")))
    names = list(docs.columns)
    k, h, n = (free_name(names, f"keep_{x}") for x in ("key", "hash", "n"))
    keep = stored(found.groupBy(F.col(f"`{key}`").alias(k), F.col("text_hash").alias(h)).agg(F.count(F.lit(1)).alias(n), F.max("n_shingles").alias("size")))
    here = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    same = F.col(f"`{key}`").eqNullSafe(F.col(k)) & (here == F.col(h))
    rows = docs.join(keep.select(k, h), same, "left_semi")
    many = keep.where((F.col(n) > 1) & (F.col("size") > 0)).select(k, h)
    if many.limit(1).count() == 0:
        return rows
    order = Window.partitionBy(F.col(f"`{key}`"), here).orderBy(F.lit(1))
    again = rows.join(many, same, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return rows.join(many, same, "left_anti").unionByName(again)
