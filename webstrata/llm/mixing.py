"""Mixing sources to target weights, by fixed-length blocks of tokens.

Each source's documents, in a fixed pseudorandom order, form one stream of words cut
into blocks of `block_words`. The mix is a row of slots. Every output shard draws
multinomial counts of slots per source, from the slots each source has left, so the
totals are exact. A source's i-th slot maps to a block through a pseudorandom
permutation of block indices, a new one each time the source is used up; blocks are
then joined by index. A source's last slot takes the first words of its block only,
so it ends at its target, rounded down.

Only one row per source goes to the driver, MOST_SOURCES at most; more are an error.
Positions in a stream come from ranks within many buckets and a small table of bucket
sums; no task sees a whole source. Equal rows are counted first and numbered after,
so they fall into many buckets too.

Defined results: a null text has size 0; documents of size 0 are never taken; a
null source is a source of its own, the last; equal rows are taken one by one; an
empty table gives an empty one; other columns stay, whatever their names. Reruns
agree, as all draws follow from `seed`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from webstrata.llm._io import free_name, stored
from webstrata.llm._text import SPACED, column, flat, mix, slices, words

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4
RANKED = 1_024
#: What the driver may hold: a row per source, and its slots in each output shard.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """By weight, up to `most` times a source's size; what is above is shared again until none is."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    total = share * float(sum(sizes))
    held = cap <= 0
    out = np.where(held, 0.0, 0.0)
    while (~held).any():
        left = total - cap[held].sum()
        out = np.where(held, cap, left * w / w[~held].sum())
        over = ~held & (out > cap)
        if not over.any():
            break
        held |= over
        out = np.where(held, cap, out)
    return out.tolist()


def _halves(n: np.ndarray) -> np.ndarray:
    """Bits of each half of a Feistel network over at least n values."""
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float)) + 1e-9).astype(np.int64)
    return np.maximum(1, (bits + 1) // 2).astype(np.uint64)


def _rounds(x: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    a, b = x >> half, x & mask
    with np.errstate(over="ignore"):
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ (mix(a + key + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & mask), a
            else:
                a, b = b, a ^ (mix(b + key + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & mask)
    return (a << half) | b


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), by cycle walking; back: its inverse."""
    i, n, key = (np.asarray(x, np.uint64) for x in (i, n, key))
    half = _halves(n)
    x = _rounds(i, half, key, back)
    while (out := x >= n).any():
        x[out] = _rounds(x[out], half[out], key[out], back)
    return x.astype(np.int64)


def epoch_key(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(np.asarray(source, np.uint64) + np.uint64(seed * 2 + 1)) + np.asarray(epoch, np.uint64))


@dataclass
class Plan:
    """One entry per source, and a row of counts per output shard."""

    size: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    quota: np.ndarray
    ends: np.ndarray
    seed: int
    block_words: int


def plan(sizes: list[int], target: list[float], block_words: int, n_shards: int, seed: int) -> Plan:
    size, quota = np.array(sizes, np.int64), np.floor(np.array(target) + 1e-6).astype(np.int64)
    blocks = -(-size // block_words)
    slots = np.zeros(len(size), np.int64)
    for s in np.flatnonzero(quota > 0):
        epochs, rest = divmod(int(quota[s]), int(size[s]))
        more = 0
        if rest:
            ragged = blocks[s] * block_words - size[s]
            at = permute(np.array([blocks[s] - 1]), np.array([blocks[s]]), epoch_key(np.array([s]), np.array([epochs]), seed), back=True)[0]
            more = -(-rest // block_words)
            if more > at:
                more = -(-(rest + ragged) // block_words)
        slots[s] = epochs * blocks[s] + more
    rng = np.random.default_rng(seed)
    left, counts = slots.copy(), np.zeros((n_shards, len(size)), np.int64)
    for k in range(n_shards):
        want = int(left.sum()) // (n_shards - k)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            counts[k] += got
            left -= got
            want -= int(got.sum())
    return Plan(size, blocks, slots, quota, counts.cumsum(0), seed, block_words)


def fill_slots(ids: np.ndarray, p: Plan) -> dict[str, np.ndarray]:
    """Source, epoch, block, words taken and output shard of global slot numbers."""
    ends = np.cumsum(p.slots)
    s = np.searchsorted(ends, ids, "right")
    i = ids - (ends - p.slots)[s]
    epoch, at = i // p.blocks[s], i % p.blocks[s]
    key = epoch_key(s, epoch, p.seed)
    block = permute(at, p.blocks[s], key)
    length = np.minimum(p.block_words, p.size[s] - block * p.block_words)
    last = np.flatnonzero(i == p.slots[s] - 1)
    if len(last):
        sl = s[last]
        ragged = permute(p.blocks[sl] - 1, p.blocks[sl], key[last], back=True)
        missing = p.blocks[sl] * p.block_words - p.size[sl]
        before = epoch[last] * p.size[sl] + at[last] * p.block_words - np.where(ragged < at[last], missing, 0)
        length[last] = np.minimum(length[last], p.quota[sl] - before)
    shard = np.array([np.searchsorted(p.ends[:, a], b, "right") for a, b in zip(s.tolist(), i.tolist(), strict=True)], np.int64) if len(p.ends) < 2 else _shards(s, i, p.ends)
    return {"source_ix": s, "epoch": epoch, "block": block, "words": length, "out_shard": shard}


def _shards(s: np.ndarray, i: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), np.int64)
    for a in np.unique(s):
        rows = s == a
        out[rows] = np.searchsorted(ends[:, a], i[rows], "right")
    return out


@dataclass
class Mix:
    """documents: identity, source, size, start in the stream; slots: what each output shard takes."""

    documents: DataFrame
    slots: DataFrame
    sources: list[dict]
    block_words: int

    def pieces(self) -> DataFrame:
        """Rows (identity, start, size, epoch, out_shard, from_word, to_word): what is taken of each document."""
        b = F.lit(self.block_words)
        d = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        end = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
        begin = F.greatest("start", F.col("block") * b)
        return d.join(self.slots, ["source_ix", "block"]).withColumns({"from_word": begin - F.col("start"), "to_word": end - F.col("start")}).where("to_word > from_word")


def _identity(key: str, source: str, text: str) -> list[Column]:
    """128 bits of hash of a row; never null, so that joins on them are plain equalities."""
    k, s, t = (F.col(f"`{c}`") for c in (key, source, text))
    none = F.when(k.isNull(), 1).otherwise(0) + F.when(s.isNull(), 2).otherwise(0) + F.when(t.isNull(), 4).otherwise(0)
    return [F.xxhash64(none, k, s, t), F.xxhash64(F.lit(7), none, t, F.octet_length(t.cast("string")), s, k)]


def mix_sources(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 512, n_shards: int = 64, seed: int = 20) -> Mix:
    """Plans the mix. One pass over the texts counts words; all that follows works on narrow rows."""
    spark = docs.sparkSession
    col = lambda c: F.col(f"`{c}`")
    one, two = _identity(key, source, text)
    each = docs.select(
        col(key).alias("key"),
        col(source).alias("source"),
        F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        one.alias("id1"),
        two.alias("id2"),
    )
    # equal rows as one row with their number, so that a task sees few of them
    narrow = stored(each.groupBy("id1", "id2").agg(F.first("key").alias("key"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    of_source = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(of_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = {r["source"]: (r["size"], r["n"]) for r in of_source}
    names = sorted(found, key=lambda x: (x is None, x or ""))
    sizes = [found[x][0] for x in names]
    target = targets(sizes, weights, share, most)
    p = plan(sizes, target, block_words, n_shards, seed)
    # from Arrow, as a list goes through Python workers of another kind, which stay beside those that run functions
    kinds = {"source_ix": pa.int32(), "name": pa.string(), "source_size": pa.int64(), "target": pa.float64()}
    facts = spark.createDataFrame(pa.table([range(len(names)), names, sizes, target], schema=pa.schema(list(kinds.items()))))
    buckets = 1 + sum(n for _, n in found.values()) // RANKED
    rows = (
        narrow.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("bucket", F.pmod(F.xxhash64("id1", "nth", F.lit(seed)), F.lit(buckets)))
    )
    sums = rows.groupBy("source_ix", "bucket").agg(F.sum("size").alias("held"))
    w = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sums.select("source_ix", "bucket", (F.sum("held").over(w) - F.col("held")).alias("base"))
    within = Window.partitionBy("source_ix", "bucket").orderBy("key", "id1", "id2", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    documents = rows.withColumn("upto", F.sum("size").over(within)).join(base, ["source_ix", "bucket"])
    documents = documents.select("key", "source", "source_ix", "source_size", "target", "size", "id1", "id2", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    shared = spark.sparkContext.broadcast(p)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fill_slots(np.asarray(batch.column(0)), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got.values()], list(got))

    n = int(p.slots.sum())
    slots = spark.range(0, n, 1, max(1, min(4096, n // 100_000 + 1))).mapInArrow(fill, "source_ix long, epoch long, block long, words long, out_shard long")
    slots = slots.withColumn("source_ix", F.col("source_ix").cast("int"))
    return Mix(documents, slots, [{"source": a, "size": b, "target": c} for a, b, c in zip(names, sizes, target, strict=True)], block_words)


def taken(m: Mix) -> DataFrame:
    """Per document: what the mix takes of it, in words, repeats counted."""
    cols = ["key", "source", "source_size", "target", "size", "source_ix", "start"]
    took = m.pieces().groupBy("source_ix", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    full = m.documents.where("size > 0").select(*cols).join(took, ["source_ix", "start"], "left")
    none = m.documents.where("size = 0").select(*cols).withColumn("taken", F.lit(None).cast("long"))
    return full.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("source_ix", "start")


def mixed(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row per document and epoch, its text cut to the words taken.

    A text taken whole is unchanged; of others the taken runs are joined by a space.
    The texts are shuffled once, by the identity of their rows, for both the join and
    the choice of one of equal rows.
    """
    m = mix_sources(docs, key=key, source=source, text=text, **options)
    names = list(docs.columns)
    id1, id2, nth, size, runs = (free_name(names, f"mix_{x}") for x in ("id1", "id2", "nth", "size", "runs"))
    found = m.pieces().groupBy("source_ix", "start", "epoch").agg(F.first("id1").alias(id1), F.first("id2").alias(id2), F.first("size").alias(size), F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias(runs))
    one, two = _identity(key, source, text)
    # of equal rows the first stands for all, as their runs already come one by one
    first = F.row_number().over(Window.partitionBy(id1, id2).orderBy(F.lit(1)))
    each = docs.withColumns({id1: one, id2: two}).withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    joined = each.join(found.select(id1, id2, size, runs), [id1, id2]).select(*[F.col(f"`{c}`") for c in names], size, runs)
    schema = T.StructType([docs.schema[c] for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield _cut(part, names, text, size, runs)

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _cut(part: pa.RecordBatch, names: list[str], text: str, size: str, runs: str) -> pa.RecordBatch:
    """The rows of `part` with their texts cut to their runs."""
    texts, found = column(part, text), column(part, runs)
    values, per = found.flatten(), np.asarray(found.value_lengths())
    begin, end = (np.asarray(values.field(i)) for i in range(2))
    cut_at = np.concatenate([[0], np.cumsum(per)])
    whole = np.asarray(column(part, size))
    out: list[str | None] = []
    for i, total in enumerate(whole.tolist()):
        a, b = begin[cut_at[i] : cut_at[i + 1]], end[cut_at[i] : cut_at[i + 1]]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != b[:-1]
        a, b = a[first], b[np.append(first[1:], True)]
        if len(a) == 1 and a[0] == 0 and b[0] == total:
            out.append(texts[i].as_py())
            continue
        data, offs = flat(texts.slice(i, 1))
        s, e, _ = words(data, offs, SPACED)
        out.append(b" ".join(data[s[x] : e[y - 1]].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)).decode())
    return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else column(part, c) for c in names], names)
