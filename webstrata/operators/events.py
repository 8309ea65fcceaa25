"""Captured network events: filters, best API bodies, pairs of actions and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import text as tx
from webstrata.functions import urls

# What tells a tracker's address.
TRACKERS = r"(?i)(?:analytics|telemetry|tracking|/track\b|/collect\b|beacon|segment|google-analytics|googletagmanager|gtag|/gtm\b|doubleclick|/pixel\b|/stats\b|/metrics\b|/rum\b|/log(?:s|ging)?\b)"


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(F.col("resource_type").isin(types))


def with_bodies(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """Responses whose content type begins with one of the prefixes."""
    ct = F.lower(F.coalesce("content_type", F.lit("")))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | ct.startswith(p.lower())
    return events.where((F.col("event_type") == "response") & hit)


def api_candidates(events: DataFrame, page: str) -> DataFrame:
    """(page, url, pos): JSON answers to script requests, the first of each address."""
    rows = events.where((F.col("event_type") == "response") & F.col("resource_type").isin("xhr", "fetch") & F.lower("content_type").contains("json"))
    return rows.groupBy(page, "url").agg(F.min("pos").alias("pos"))


def best_api_body(candidates: DataFrame, page: str) -> DataFrame:
    """Per page the best JSON body: own host +2, tracker -3, object or list +1; then the longer, then the first."""
    body = F.ltrim("body")
    own = urls.host(F.col("url")) == urls.host(F.col("page_url"))
    score = F.when(own, 2).otherwise(0) - F.when(F.col("url").rlike(TRACKERS), 3).otherwise(0) + F.when(body.startswith("{") | body.startswith("["), 1).otherwise(0)
    rows = candidates.where(F.try_parse_json("body").isNotNull()).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), F.desc(F.length("body")), "pos"))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def downloads(events: DataFrame, page: str) -> DataFrame:
    return events.where("event_type = 'download'").select(page, "pos", "url")


def audit_rows(calls: DataFrame, started: str = "started_at", ended: str = "ended_at", error: str = "error") -> DataFrame:
    """Log rows of calls: secret arguments masked, `status` ok or error, `elapsed_ms`, 0 at least.

    calls: args, times in seconds, error (null if there was none).
    """
    took = F.greatest(F.lit(0.0), F.round((F.col(ended) - F.col(started)) * 1000, 1))
    return calls.withColumns({"args": tx.redact_map(F.col("args")), "status": F.when(F.col(error).isNull(), "ok").otherwise("error"), "elapsed_ms": took})


def replay(trace: DataFrame, secrets: DataFrame) -> DataFrame:
    """A trace with secrets put back by ordinal; masked actions without a secret are dropped."""
    rows = trace.join(secrets.withColumnRenamed("value", "__secret"), "ordinal", "left")
    masked = F.exists(F.map_values("args"), lambda v: v == tx.REDACTED)
    rows = rows.where(~masked | F.col("__secret").isNotNull())
    return rows.withColumn("args", F.transform_values("args", lambda k, v: F.when(v == tx.REDACTED, F.col("__secret")).otherwise(v))).drop("__secret")


def gate_actions(actions: DataFrame, by: str, blocked: list[str]) -> DataFrame:
    """`state`: all actions of a sequence that holds a blocked kind are skipped."""
    any_ = F.max(F.col("action").isin(blocked)).over(Window.partitionBy(by))
    return actions.withColumn("state", F.when(any_, "skipped").otherwise("ready"))


def looks_like_submit(selector):
    return selector.rlike(r"(?i)type\s*=\s*[\"']?submit|\bsubmit\b|\bbtn-submit\b|button\[type=submit\]")


def destructive(label):
    return label.rlike(r"(?i)\b(?:delete|remove|pay|purchase|buy|order|confirm|send|transfer|unsubscribe|cancel)\b")


def locator(spec):
    """The part of a locator that is used: ref, role, test id, label, placeholder, text, selector."""
    return F.coalesce(*[F.when(spec[k].isNotNull(), F.concat(F.lit(f"{k}="), spec[k])) for k in ("ref", "role", "test_id", "label", "placeholder", "text", "selector")])
