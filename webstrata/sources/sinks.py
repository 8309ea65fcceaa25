"""Sinks: JSON results, append-only logs, a snapshot store, a cache with expiry."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.functions import text as tx
from webstrata.operators import snapshots


def slug(query):
    """A file name from a query: lower case, dashes, 50 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(50))


def write_json(df: DataFrame, path: str, base: str | None = None) -> None:
    """Writes JSON lines to a new folder; with `base`, only to one inside it."""
    df.write.mode("errorifexists").json(confined(base, path) if base else path)


def confined(base: str, path: str) -> str:
    """`path` under `base`; a path that leads out of it is an error. Both may be of any store."""
    scheme, mark, root = base.rpartition("://")
    whole = posixpath.normpath(posixpath.join("/" + root.strip("/"), path))
    if not whole.startswith(posixpath.normpath("/" + root.strip("/")) + "/"):
        raise ValueError(f"{path!r} leads out of the output folder")
    return f"{scheme}{mark}{whole.lstrip('/') if mark and not root.startswith('/') else whole}"


def append_log(df: DataFrame, path: str, secret: str | None = "args") -> None:
    """Rows appended as JSON lines; a column of arguments is masked by key."""
    if secret and secret in df.columns:
        df = df.withColumn(secret, tx.redact_map(F.col(secret)))
    df.write.mode("append").json(path)


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    """`ordinal` from 0 in each session."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def save_snapshots(df: DataFrame, path: str) -> None:
    """Appends versions; a label's versions lie in one of 64 folders, so a look-up reads one."""
    df.withColumn("bucket", F.pmod(F.hash("label"), F.lit(64))).write.mode("append").partitionBy("bucket").parquet(path)


def load_snapshot(spark: SparkSession, path: str, label: str) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("label") == label) & (F.col("bucket") == F.pmod(F.hash(F.lit(label)), F.lit(64))))
    return snapshots.latest(rows.drop("bucket"))


def cache_key(key):
    return F.left(tx.content_hash(key), F.lit(32))


def cache_get(cache: DataFrame, keys: DataFrame, now: float, ttl: float) -> DataFrame:
    """Cached values of keys that haven't expired. cache: (key, value, stored_at); keys: (key)."""
    return keys.join(cache.where(F.lit(now) - F.col("stored_at") <= ttl), "key")


def cache_evict(cache: DataFrame, most_bytes: int) -> DataFrame:
    """The newest entries whose sizes fit together; entries stored at one time go by key.

    cache: (key, size, stored_at, ...). No task ranks all entries: sums of ranges of time
    tell in which range the room ends, sums of its times at which time, and sums of
    ranges of keys which entries of that time stay.
    """
    at = F.col("stored_at").cast("double")
    newest = _room(cache, at, most_bytes, newest=True)
    if newest is None:
        return cache
    time, room = newest
    ties = cache.where(at == time)
    # in the order of keys: the first characters, then whole keys
    head = F.ascii("key").cast("double") * 65536 + F.ascii(F.substring("key", 2, 1))
    last = _room(ties, head, room, newest=False)
    if last is not None:
        begin, left = last
        end = ties.where(head == begin).withColumn("running", F.sum("size").over(Window.orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= left).drop("running")
        ties = ties.where(head < begin).unionByName(end)
    return cache.where(at > time).unionByName(ties)


def _room(rows: DataFrame, order, most: int, *, newest: bool, ranges: int = 4096) -> tuple[float, int] | None:
    """(value, room): rows before that value of `order` fit, and what is left for those at it; null if all fit."""
    low, high, total = rows.agg(F.min(order), F.max(order), F.coalesce(F.sum("size"), F.lit(0))).first()
    if total <= most:
        return None

    def first_over(part: DataFrame, by, most: int):
        sums = part.groupBy(by.alias("at")).agg(F.sum("size").alias("held"))
        upto = F.sum("held").over(Window.orderBy(F.desc("at") if newest else "at").rowsBetween(Window.unboundedPreceding, 0))
        r = sums.withColumn("upto", upto).where(F.col("upto") > most).orderBy("upto").first()
        return r["at"], most - int(r["upto"] - r["held"])

    if low == high:
        return low, most
    within = F.width_bucket(order, F.lit(low), F.lit(high), F.lit(ranges).cast("long"))
    bucket, room = first_over(rows, within, most)
    return first_over(rows.where(within == bucket), order, room)
