"""Links of pages: extraction, scope, first occurrences, off-site counts, site maps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import html, urls

HREF = r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"
# Schemes that lead to no page.
NOT_PAGES = r"(?i)^(?:mailto:|javascript:|tel:|data:|ftp:|file:|about:|blob:)"


def raw_links(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, base, pos, href) of every href attribute in the markup, in order; scripts and comments count too."""
    return pages.select(F.col(key), F.col(url).alias("base"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(HREF), 1)).alias("pos", "href")).withColumn("href", F.trim("href"))


def extract_links(pages: DataFrame, *, key: str = "page_id", url: str = "url", text: str = "html", wide: bool = False, cap: int = 200, include: list[str] | None = None, exclude: list[str] | None = None, in_python: bool = False) -> DataFrame:
    """(key, pos, url): absolute http(s) links in scope, first occurrences in order, `cap` per page.

    in_python resolves dot segments too; the native form covers all other references.
    """
    rows = raw_links(pages, key, url, text)
    rows = rows.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").rlike(NOT_PAGES))
    target = html.resolved(F.col("base"), F.col("href")) if in_python else urls.without_fragment(urls.resolve(F.col("base"), F.col("href")))
    rows = rows.withColumn("link", target).where(F.col("link").rlike(r"(?i)^https?://"))
    rows = rows.where(urls.in_scope(urls.host(F.col("link")), urls.host(F.col("base")), wide))
    for pattern in [include or []]:
        if pattern:
            rows = rows.where(_any(pattern))
    if exclude:
        rows = rows.where(~_any(exclude))
    first = first_occurrence(rows, [key, "link"], "pos")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= cap).select(key, (F.col("rank") - 1).alias("pos"), F.col("link").alias("url"))


def _any(patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("link").rlike(p)
    return out


def first_occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first one. A partial minimum runs before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def offsite_count(pages: DataFrame, *, key: str = "page_id", url: str = "url", text: str = "html", wide: bool = False) -> DataFrame:
    """(key, n): distinct http(s) links that leave the page's scope."""
    rows = raw_links(pages, key, url, text)
    link = urls.without_fragment(urls.resolve(F.col("base"), F.col("href")))
    rows = rows.where(~F.col("href").startswith("#") & ~F.col("href").rlike(NOT_PAGES)).withColumn("link", link).where(F.col("link").rlike(r"(?i)^https?://"))
    out = F.when(~urls.in_scope(urls.host(F.col("link")), urls.host(F.col("base")), wide), F.col("link"))
    return rows.groupBy(key).agg(F.count_distinct(out).alias("n"))


def seed_sitemap(maps: DataFrame, root: str, scope: str, *, wide: bool = False, children: int = 10, cap: int = 1000) -> DataFrame:
    """(pos, url): locations in scope of a root site map, or of its first `children` site maps if it is an index.

    maps: (url, xml). What isn't in the table counts as unreadable.
    """

    @F.arrow_udf("array<string>")
    def locations(xml: pa.Array) -> pa.Array:
        return pa.array([html.sitemap_locations(x or "", cap)[0] for x in xml.to_pylist()], pa.list_(pa.string()))

    m = maps.withColumn("index", F.col("xml").rlike("(?i)<sitemapindex")).withColumn("locs", locations("xml"))
    top = m.where(F.col("url") == root)
    direct = top.where(~F.col("index")).select(F.lit(0).alias("part"), F.posexplode("locs").alias("pos", "loc"))
    parts = top.where("index").select(F.posexplode("locs").alias("part", "child")).where(urls.in_scope(urls.host(F.col("child")), F.lit(scope), wide)).where(F.col("part") < children)
    nested = parts.join(m.select(F.col("url").alias("child"), "locs"), "child").select("part", F.posexplode("locs").alias("pos", "loc"))
    rows = direct.unionByName(nested).where(urls.in_scope(urls.host(F.col("loc")), F.lit(scope), wide))
    first = first_occurrence(rows.withColumn("place", F.struct("part", "pos")), ["loc"], "place")
    # a top-k: every task keeps its first `cap` rows only
    return first.orderBy("place").limit(cap).select(F.col("loc").alias("url"), "part", "pos")
