"""Ranking of result lists, provider fallback, budgets and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import text as tx
from webstrata.functions import urls

# Domains of good standing.
WELL_KNOWN = ["wikipedia.org", "github.com", "stackoverflow.com", "arxiv.org", "python.org", "mozilla.org", "nature.com", "nih.gov", "edu", "gov"]
# Named lists of preferred domains.
PROFILES = {
    "official_sources": ["ec.europa.eu", "esma.europa.eu", "eba.europa.eu", "sec.gov", "treasury.gov", "federalreserve.gov", "bis.org", "imf.org", "worldbank.org", "oecd.org", "un.org", "europa.eu", "gov", "gov.uk", "gov.in"],
    "docs": ["docs.python.org", "developer.mozilla.org", "tldp.org", "readthedocs.io", "readthedocs.org", "pkg.go.dev", "rust-lang.org", "kubernetes.io", "docs.aws.amazon.com", "cloud.google.com", "learn.microsoft.com"],
    "research": ["arxiv.org", "ssrn.com", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "nature.com", "science.org", "acm.org", "ieee.org", "researchgate.net", "papers.ssrn.com", "openreview.net"],
    "news": ["reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "ft.com", "wsj.com", "bloomberg.com", "nytimes.com", "economist.com", "axios.com", "theguardian.com"],
    "files": ["sec.gov", "ec.europa.eu", "esma.europa.eu", "data.gov", "data.gov.uk", "github.com", "githubusercontent.com", "huggingface.co", "kaggle.com", "zenodo.org", "figshare.com"],
}


def hints(prefer: list[str] | None, profile: str | None, extra: dict[str, list[str]] | None = None) -> list[str]:
    """The profile's domains, then the caller's; an unknown profile adds none. extra: further or replaced profiles."""
    return [*(PROFILES | (extra or {})).get(profile or "", []), *(prefer or [])]


def overlap(query: Column, result: Column) -> Column:
    """Share of the query's tokens that the result has; 0 without tokens."""
    q = tx.rank_tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.rank_tokens(result))) / F.size(q)).otherwise(0.0)


def score(query: Column, item: Column, url: Column, position: Column, *, scheme: str = "default", prefer: list[str] | None = None) -> Column:
    """position: 1 / place; overlap: token share; default: token share and bonuses for https, domains and place."""
    place = F.lit(1.0) / F.greatest(F.lit(1), position)
    if scheme == "position":
        return place
    if scheme == "overlap":
        return overlap(query, item)
    h = urls.host(url)
    known = F.lit(False)
    for d in WELL_KNOWN:
        known = known | urls.under_domain(h, d)
    liked = F.lit(False)
    for d in prefer or []:
        liked = liked | urls.under_domain(h, d.lower())
    return (
        overlap(query, item)
        + F.when(F.lower(url).startswith("https:"), 0.30).otherwise(0.0)
        + F.when(known, 0.20).otherwise(0.0)
        + F.when(liked, 0.40).otherwise(0.0)
        - F.when(F.size(F.split(h, r"\.")) > 3, 0.10).otherwise(0.0)
        + place * 0.10
    )


def top(rows: DataFrame, by: list[str], score_col: str, order: str, n: int) -> DataFrame:
    """The n best of each group with their `rank`; ties go to the earlier. Ranks are cut before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score_col), order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def first_provider(rows: DataFrame, query: str, rank: str) -> DataFrame:
    """Rows of the first provider, by rank, that has any for a query."""
    best = rows.groupBy(query).agg(F.min(rank).alias("__best"))
    return rows.join(best, query).where(F.col(rank) == F.col("__best")).drop("__best")


def search_outcome(attempts: DataFrame, query: str) -> DataFrame:
    """Per query: results, and whether it is degraded: empty with a provider blocked, failing or cooling down."""
    return attempts.groupBy(query).agg(F.sum("n_results").alias("n_results"), F.count_if(F.col("outcome").isin("blocked", "error", "cooldown")).alias("n_bad")).withColumn("degraded", (F.col("n_results") == 0) & (F.col("n_bad") > 0))


def budget(rows: DataFrame, by: list[str], order: str, size: str, *, pages: int, chars: int, times: str | None = None, seconds: float | None = None) -> DataFrame:
    """Rows that a budget lets through: `pages` at most; what overflows `chars` is kept and is the last; none after `seconds`.

    The running sum is over one group at a time; groups are what one call reads.
    """
    w = Window.partitionBy(*by).orderBy(order)
    spent = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("spent", spent).withColumn("page", F.row_number().over(w))
    ok = (F.col("page") <= pages) & (F.col("spent") <= chars)
    if times is not None and seconds is not None:
        ok = ok & (F.coalesce(F.max(times).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)) <= seconds)
    return out.where(ok)


def keep_recent(rows: DataFrame, by: list[str], newest: list, size: str, most: int) -> DataFrame:
    """Rows that stay when the oldest are evicted until the rest fits `most`: newest first, by running size."""
    w = Window.partitionBy(*by).orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)


def last_n(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def skip_after_failure(rows: DataFrame, by: list[str], order: str, failed: Column) -> DataFrame:
    """`state`: failed, ok, or skipped after the group's first failure."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(failed.cast("int")).over(w), F.lit(0))
    return rows.withColumn("state", F.when(before == 1, "skipped").when(failed, "failed").otherwise("ok"))


def remaining_pages(rows: DataFrame, by: list[str], order: str, pages_left: str, chars_left: str) -> DataFrame:
    """The first rows of each group, as many as it may still read; none once its characters are used up."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("__r", rank).where((F.col("__r") <= F.col(pages_left)) & (F.col(chars_left) > 0)).drop("__r")
