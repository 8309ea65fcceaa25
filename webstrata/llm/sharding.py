"""Sharding by jump consistent hashing (built-in functions only).

The shard of a row follows from its key and the number of shards alone; with one
shard more, rows move only into the new one. No ring or table is kept.

Defined results: a null key is one key like any other; equal keys share a shard; a
null text has no checksum and no bytes; rows that are equal in every column used
get neighbouring slots; an empty table gives an empty one. Further columns are
carried along unless their names clash with those that this operator adds: the
added ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from webstrata.llm._io import free_name

#: Rows that one task ranks, about.
RANKED = 50_000


def jump(key: Column, n_shards: int) -> tuple[Column, Column]:
    """The key's shard among n_shards, and among one more.

    Jumps draw from a hash of the key and the jump's number. A key jumps about
    ln(n) times; the first fold has room for nearly all, a second, evaluated only
    where it is needed, for the rest, n jumps at the most.
    """
    if n_shards < 1:
        raise ValueError("at least one shard")

    def step(acc: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        ahead = F.floor((acc["to"] + 1).cast("double") * F.lit(float(1 << 31)) / draw.cast("double")).cast("long")
        on = acc["to"] < n_shards
        return F.struct(F.when(on, acc["to"]).otherwise(acc["at"]).alias("at"), F.when(on, ahead).otherwise(acc["to"]).alias("to"))

    first = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    room = min(n_shards, 24 + 4 * n_shards.bit_length())
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(room - 1)), first, step)
    if room < n_shards:
        more = lambda: F.aggregate(F.sequence(F.lit(room), F.lit(n_shards - 1)), walk, step)
        walk = F.when(walk["to"] < n_shards, more()).otherwise(walk)
    return walk["at"].cast("int"), F.when(walk["to"] == n_shards, F.lit(n_shards)).otherwise(walk["at"]).cast("int")


def assign(rows: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with `size`, `text_crc32`, `law`, `shard`, `slot` and `grown_shard`.

    Slots count the rows of a shard from 0 without gaps. A shard is ranked in many
    buckets, dealt by a hash of key and text; a small table of bucket counts turns
    ranks within buckets into slots, so no task sees a whole shard.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in rows.columns if c.lower() not in added and (keep_text or c != text)]
    bucket, deal, base = (free_name(rows.columns, x) for x in ("bucket", "deal", "base"))
    buckets = 1 + rows.count() // (RANKED * n_shards)
    raw = F.col(f"`{text}`").cast("binary")
    both = F.struct(*jump(F.col(f"`{key}`"), n_shards))
    dealt = (
        rows.withColumn(deal, both)
        .select(
            *[F.col(f"`{c}`") for c in keep],
            (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(raw).cast("long").alias("text_crc32"),
            F.lit("key").alias("law"),
            F.col(deal)["col1"].alias("shard"),
            F.col(deal)["col2"].alias("grown_shard"),
        )
        .withColumn(bucket, F.pmod(F.xxhash64(f"`{key}`", "text_crc32", "size"), F.lit(buckets)))
    )
    ranked = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("shard", bucket).orderBy(f"`{key}`", "text_crc32", "size")).cast("long") - 1)
    if buckets > 1:
        counts = dealt.groupBy("shard", bucket).count()
        before = F.sum("count").over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
        ranked = ranked.join(counts.select("shard", bucket, before.alias(base)), ["shard", bucket]).withColumn("slot", F.col("slot") + F.col(base))
    return ranked.select(*[F.col(f"`{c}`") for c in keep], *[F.col(c) for c in added])
