"""Streaming forms of the metric operators; the same functions run on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_bound(events: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark on a stream, the rows themselves on a batch."""
    return events.withWatermark(at, late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, *, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type; windows tumble, or slide if `slide` is given."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return late_bound(events, at, late).groupBy(w.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, *, by: str = "user_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return late_bound(events, at, late).groupBy(by, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, keys: list[str], *, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First rows of each key; on a stream only as long as the watermark keeps the key."""
    return late_bound(events, at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def pairs(requests: DataFrame, responses: DataFrame, on: str, *, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests with their responses, a stream-stream outer join on streams; `elapsed_ms` is null without one."""
    a = late_bound(requests.select(F.col(on).alias("k"), F.col("ts").alias("asked_at")), "asked_at", late)
    b = late_bound(responses.select(F.col(on).alias("k2"), F.col("ts").alias("answered_at")), "answered_at", late)
    met = a.join(b, F.expr(f"k = k2 and answered_at >= asked_at and answered_at <= asked_at + interval {within}"), "leftOuter")
    return met.select("k", "asked_at", ((F.unix_micros("answered_at") - F.unix_micros("asked_at")) / 1000).alias("elapsed_ms"))
