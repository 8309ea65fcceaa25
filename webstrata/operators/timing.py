"""Operators over event time: rate limits, back-off, circuit breakers, sessions, look-ups with expiry, pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(arrivals: DataFrame, by: str, at: str, gap: Column) -> DataFrame:
    """`granted`: when each arrival may go, one per `gap` and group; the recurrence max(a, last + gap) in closed form."""
    w = Window.partitionBy(by).orderBy(at, *[c for c in ("event_id",) if c in arrivals.columns])
    n = F.row_number().over(w) - 1
    rows = arrivals.withColumn("__n", n)
    lead = F.max(F.col(at) - F.col("__n") * gap).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("granted", F.col("__n") * gap + lead).drop("__n")


def _same(a: object, b: object) -> bool:
    """Whether two group keys are one; null is a group of its own."""
    return a == b or (b is not None and not isinstance(b, _Start) and pd.isna(a) and pd.isna(b)) or (a is None and b is None)


class _Start:
    """Stands for the group before the first row."""


def _streamed(calls: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Each group in one partition, in order; groups follow one another."""
    return calls.repartition(F.col(by)).sortWithinPartitions(by, *order)


def rate_limit_with_backoff(calls: DataFrame, by: str, at: str, *, gap: float, most: float = 300.0, tie: str = "event_id") -> DataFrame:
    """`granted` where responses of 429 push the next grant by min(max(retry_after, 2 gap), most).

    calls: group, time, status, retry_after (seconds, null), and `tie`, which orders calls
    of one time and names them in the result. Each group's state is one number, rows
    stream through in batches. A null group is a group.
    """
    schema = f"{by} {calls.schema[by].dataType.simpleString()}, {at} double, {tie} {calls.schema[tie].dataType.simpleString()}, granted double"
    rows = _streamed(calls.select(by, F.col(at).cast("double").alias(at), tie, "status", F.col("retry_after").cast("double").alias("retry_after")), by, [at, tie])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, free = _Start(), float("-inf")
        for batch in batches:
            granted = []
            for g, a, status, wait in batch[[by, at, "status", "retry_after"]].itertuples(index=False):
                if not _same(g, group):
                    group, free = g, float("-inf")
                t = max(a, free)
                free = t + gap
                if status == 429:
                    free = max(free, t + min(max(0.0 if pd.isna(wait) else wait, 2 * gap), most))
                granted.append(t)
            yield batch[[by, at, tie]].assign(granted=granted)

    return rows.mapInPandas(run, schema)


def circuit_breaker(calls: DataFrame, by: str, at: str, *, trips: str, cooldown: float, tie: str = "event_id") -> DataFrame:
    """`allowed`: false within `cooldown` of the last trip; an allowed failure trips anew, an allowed success clears.

    `tie` orders calls of one time and names them in the result. A null group is a group.
    """
    schema = f"{by} {calls.schema[by].dataType.simpleString()}, {at} double, {tie} {calls.schema[tie].dataType.simpleString()}, allowed boolean"
    rows = _streamed(calls.select(by, F.col(at).cast("double").alias(at), tie, F.coalesce(F.col(trips).cast("boolean"), F.lit(False)).alias("trip")), by, [at, tie])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, tripped = _Start(), None
        for batch in batches:
            allowed = []
            for g, a, trip in batch[[by, at, "trip"]].itertuples(index=False):
                if not _same(g, group):
                    group, tripped = g, None
                ok = tripped is None or a - tripped >= cooldown
                if ok:
                    tripped = a if trip else None
                allowed.append(ok)
            yield batch[[by, at, tie]].assign(allowed=allowed)

    return rows.mapInPandas(run, schema)


def idle_sessions(events: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """(group, session, first, last, n): a session ends when the next event is more than `gap` later."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    rows = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(by, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, ttl: int | None = None) -> DataFrame:
    """For each left row the latest right row not after it, if it is not older than `ttl`.

    Both sides are merged and sorted once; no row meets more than one other.
    """
    cols = [c for c in left.columns if c not in (by, at)]
    a = left.select(by, at, F.struct(*cols).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[at].dataType).alias("__t"), F.lit(1).alias("__side"))
    b = right.select(by, at, F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"), F.col(at).alias("__t"), F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__side") == 0, F.struct("__v", "__t")), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("__m", last).where("__side = 1")
    fresh = F.lit(True) if ttl is None else F.col(at) - F.col("__m.__t") <= ttl
    return out.select(by, at, *[F.col(f"__l.{c}").alias(c) for c in cols], F.when(fresh, F.col("__m.__v")).alias(value), F.when(fresh, F.col("__m.__t")).alias("found_at"))


def pair(events: DataFrame, by: str, at: str, kind: str, first: str, second: str) -> DataFrame:
    """Each `second` event with the latest `first` event before it in its group and the time between; 0 without one."""
    w = Window.partitionBy(by).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col(kind) == first, F.col(at)), ignorenulls=True).over(w)
    return events.where(F.col(kind).isin(first, second)).withColumn("start", start).where(F.col(kind) == second).withColumn("elapsed", F.coalesce(F.col(at) - F.col("start"), F.lit(0)))


def settled(attempts: DataFrame, by: str, order: str, confidence: str, below: float) -> DataFrame:
    """The first attempt of each group with no or a low confidence."""
    ok = F.col(confidence).isNull() | (F.col(confidence) < below)
    return attempts.where(ok).groupBy(by).agg(F.min(order).alias(order))


def exhausted(heights: DataFrame, by: str, order: str, height: str, rounds: int, most: int) -> DataFrame:
    """The step at which scrolling ends: `rounds` steps in a row without growth, or step `most`, or the last."""
    w = Window.partitionBy(by).orderBy(order)
    rows = heights.withColumn("__grew", F.coalesce((F.col(height) > F.lag(height).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__grew").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__still", F.row_number().over(Window.partitionBy(by, "__run").orderBy(order)) - 1)
    stop = F.min(F.when((F.col("__still") >= rounds) | (F.col(order) >= most), F.col(order)))
    return rows.groupBy(by).agg(F.coalesce(stop, F.max(order)).alias("stop"))


def first_containing(steps: DataFrame, by: str, order: str, text: str, needle: str) -> DataFrame:
    """The first step whose text holds the needle; null if none does."""
    return steps.groupBy(by).agg(F.min(F.when(F.col(text).contains(needle), F.col(order))).alias("step"))


def retry_delay(attempt: Column, base: Column, most: Column, draw: Column) -> Column:
    """Seconds before a retry: min(base * 2^(attempt - 1), most), times a factor from 0.5 to 1 by `draw` (0 to 1)."""
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), most) * (F.lit(0.5) + F.lit(0.5) * draw)
