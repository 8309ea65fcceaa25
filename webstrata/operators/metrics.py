"""Metric series: counters, distributions, label caps, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_key(name: Column, labels: Column) -> Column:
    """`name`, or `name{a=1,b=2}` with sorted labels."""
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.when(labels.isNull() | (F.size(labels) == 0), name).otherwise(F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def counters(calls: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return calls.groupBy(key).agg(F.sum(value).alias("total"))


def distributions(calls: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return calls.groupBy(key).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))


def cap_series(calls: DataFrame, name: str, key: str, order: str, most: int) -> DataFrame:
    """Calls with keys beyond the first `most` of their name, by first use, moved to one overflow key.

    First uses are found by a partial minimum; only one row per series is ranked.
    """
    first = calls.groupBy(name, key).agg(F.min(order).alias("__first"))
    rank = first.withColumn("__rank", F.row_number().over(Window.partitionBy(name).orderBy("__first"))).drop("__first")
    out = calls.join(rank, [name, key])
    return out.withColumn(key, F.when(F.col("__rank") > most, F.concat(F.col(name), F.lit("{__overflow__=_other}"))).otherwise(F.col(key))).drop("__rank")


def snapshot(totals: DataFrame, key: str = "key", value: str = "total", *, since: float | None = None, now: float | None = None) -> DataFrame:
    """One row: all series as a map, and the seconds since counting began. Series are bounded by the label cap."""
    out = totals.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("series"))
    return out if since is None or now is None else out.withColumn("uptime_s", F.lit(max(0.0, now - since)))


def since_reset(calls: DataFrame, resets: DataFrame, at: str = "at") -> DataFrame:
    """Calls after the last reset. resets: one column of times, maybe empty."""
    last = resets.agg(F.max(resets.columns[0]).alias("__reset"))
    return calls.crossJoin(F.broadcast(last)).where(F.col("__reset").isNull() | (F.col(at) > F.col("__reset"))).drop("__reset")


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """Per status: reads, bytes and first-byte times."""
    return fetches.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("ttfb_ms").alias("ttfb_min"), F.max("ttfb_ms").alias("ttfb_max"))


def risk_rollup(pages: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Per group: the worst risk and how many pages have any."""
    names = F.array(*[F.lit(x) for x in ("none", "low", "medium", "high")])
    return pages.groupBy(by).agg(F.max(rank).alias("__r"), F.count_if(F.col(rank) > 0).alias("n_risky")).select(by, F.element_at(names, F.greatest(F.col("__r"), F.lit(0)) + 1).alias("worst"), "n_risky")


def crawl_summary(pages: DataFrame, by: str, links: DataFrame | None = None) -> DataFrame:
    """Per crawl: pages, greatest depth, characters, failed and disallowed pages; with links, what was discovered and left aside.

    pages: (by, url, depth, length, status). links: (by, url, offsite) as seen on the pages.
    """
    out = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages"), F.max("depth").alias("max_depth"), F.sum("length").alias("chars"),
        F.count_if(~F.col("status").isin("success", "blocked")).alias("failed"), F.count_if(F.col("status") == "blocked").alias("disallowed"),
    )
    if links is None:
        return out
    known = pages.select(by, "url", F.lit(False).alias("offsite")).unionByName(links.select(by, "url", "offsite"))
    seen = known.groupBy(by).agg(F.count_distinct(F.when(~F.col("offsite"), F.col("url"))).alias("discovered"), F.count_if("offsite").alias("offsite"))
    return out.join(seen, by, "left")


def collection_summary(pages: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Per collection: pages, characters, worst risk, pages at risk, and the reason it stopped.

    pages: (by, step, chars, rank, stop); rows with a null `chars` are where the walk ended without a page.
    """
    names = F.array(*[F.lit(x) for x in ("none", "low", "medium", "high")])
    page = F.col("chars").isNotNull()
    out = pages.groupBy(by).agg(
        F.count_if(page).alias("pages"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.max(F.when(page, F.col(rank))).alias("__r"),
        F.count_if(page & (F.col(rank) > 0)).alias("n_risky"), F.max_by("stop", "step").alias("stopped_reason"),
    )
    return out.select(by, "pages", "chars", F.element_at(names, F.greatest(F.coalesce("__r", F.lit(0)), F.lit(0)) + 1).alias("worst"), "n_risky", "stopped_reason")


def page_weight(responses: DataFrame, by: str) -> DataFrame:
    """Per page: bytes of all responses, null if none is known, and the first-byte time of the first document.

    responses: (by, pos, resource_type, bytes, ttfb_ms).
    """
    timed = (F.col("resource_type") == "document") & F.col("ttfb_ms").isNotNull()
    return responses.groupBy(by).agg(F.sum("bytes").alias("total_bytes"), F.min_by("ttfb_ms", F.when(timed, F.col("pos"))).alias("ttfb_ms"))


def health(checks: DataFrame) -> DataFrame:
    """unusable if any check fails, usable_with_warnings if any warns, else healthy; skipped checks don't count."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(F.lit("healthy"), F.lit("usable_with_warnings"), F.lit("unusable")), rank + 1).alias("summary"))


def citations(pages: DataFrame, by: str, order: str) -> DataFrame:
    """Per query: its pages in rank order, how many, and how many characters."""
    return pages.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "url"))), lambda x: x["url"]).alias("citations"), F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))


def action_counts(steps: DataFrame, by: str) -> DataFrame:
    return steps.groupBy(by).agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("total"))
