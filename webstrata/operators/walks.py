"""Walks over link tables: bounded breadth-first crawl, pagination, both as rounds of joins.

A round reads only the links of the pages it stands on. Each round's pages are
written to the checkpoint folder, so plans stay short and lost executors are no
loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.sources.session import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crawl(links: DataFrame, start: DataFrame, *, max_pages: int = 20, max_depth: int = 3, fetchable: DataFrame | None = None, seconds: DataFrame | None = None, time_budget: float | None = None) -> tuple[DataFrame, str]:
    """(url, depth, rank) in the order of a first-in-first-out frontier, and why it stopped.

    links: (src, dst, pos). A page's links count in order; the cut at `max_pages`
    is by rank. Failed pages (not in fetchable) count as pages but lead nowhere.
    seconds: (url, seconds) that each page takes, 0 if it isn't there; no page is begun
    when `time_budget` is used up. Of reasons to stop the budget comes first, then
    max_pages, max_depth and frontier_empty.
    """
    first = start.select("url").distinct().withColumns({"depth": F.lit(0), "rank": F.row_number().over(Window.orderBy("url"))}).where(F.col("rank") <= max_pages)
    seen, used = _in_time(first, seconds, time_budget, 0.0)
    front, depth, why = seen, 0, "frontier_empty"
    if first.count() > seen.count():
        return seen, "budget"
    while True:
        good = front if fetchable is None else front.join(fetchable.select("url"), "url", "left_semi")
        nxt = good.select(F.col("url").alias("src"), F.col("rank").alias("parent")).join(links, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent", "pos")).alias("place"))
        nxt = nxt.join(seen.select("url"), "url", "left_anti")
        have = seen.count()
        if have >= max_pages:
            why = "max_pages" if nxt.limit(1).count() else "frontier_empty"
            break
        if depth >= max_depth:
            why = "max_depth" if nxt.limit(1).count() else "frontier_empty"
            break
        # a top-k by place: no more than the pages left are ranked
        room = nxt.orderBy("place").limit(max_pages - have)
        asked = _cut(room.select("url", F.lit(depth + 1).alias("depth"), (F.row_number().over(Window.orderBy("place")) + have).alias("rank")))
        n = asked.count()
        if n == 0:
            break
        front, used = _in_time(asked, seconds, time_budget, used)
        seen = _cut(seen.unionByName(front))
        if time_budget is not None and front.count() < n:
            why = "budget"
            break
        depth += 1
    return seen, why


def _in_time(pages: DataFrame, seconds: DataFrame | None, budget: float | None, used: float) -> tuple[DataFrame, float]:
    """The pages that are begun before the budget is used up, and the time used after them."""
    if seconds is None or budget is None:
        return _cut(pages), used
    timed = pages.join(seconds.select("url", "seconds"), "url", "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    before = F.coalesce(F.sum("seconds").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + used
    kept = _cut(timed.withColumn("before", before).where(F.col("before") < budget))
    return kept.select("url", "depth", "rank"), used + float(kept.agg(F.coalesce(F.sum("seconds"), F.lit(0.0))).first()[0])


def collect_pages(pages: DataFrame, start: DataFrame, *, max_pages: int = 10, strategy: str = "next_link", max_chars: int | None = None) -> DataFrame:
    """(walk, step, url, hash, chars, stop): many pagination walks at once, each by its pages' `next_url`.

    pages: (url, next_url, hash), and if they are there status and chars. A walk stops at
    a page that it has read (cycle), that is missing or failed (error) or refused
    (blocked), whose text it has read (cycle, or empty_page where pages are numbered:
    strategy page_param), that is empty (empty_page, numbered pages only), at its last
    page (no_next), when its characters pass `max_chars` (budget), or after max_pages.
    The row of a page that isn't kept has null chars.
    """
    numbered = strategy == "page_param"
    optional = {"status": F.lit("success"), "chars": F.lit(1).cast("long")}
    table = pages.select("url", "next_url", "hash", *[F.col(c) if c in pages.columns else x.alias(c) for c, x in optional.items()])
    table = table.withColumns({"chars": F.col("chars").cast("long"), "hash": F.when(F.col("chars") > 0, F.col("hash"))})
    none = F.array().cast("array<string>")
    at = start.select("walk", F.col("url"), F.lit(1).alias("step"), none.alias("urls"), none.alias("hashes"), F.lit(0).cast("long").alias("spent"))
    done = None
    for step in range(1, max_pages + 1):
        here = at.join(table.withColumnRenamed("url", "__u"), F.col("url") == F.col("__u"), "left")
        again = F.col("hash").isNotNull() & F.array_contains("hashes", F.col("hash"))
        unread = (
            F.when(F.array_contains("urls", F.col("url")), "cycle")
            .when(F.col("status") == "blocked", "blocked")
            .when(F.col("__u").isNull() | (F.col("status") != "success"), "error")
            .when(again, "empty_page" if numbered else "cycle")
            .when(F.lit(numbered) & (F.coalesce("chars", F.lit(0)) == 0), "empty_page")
        )
        spent = F.col("spent") + F.coalesce("chars", F.lit(0))
        over = F.lit(False) if max_chars is None else spent > max_chars
        stop = F.coalesce(unread, F.when(over, "budget").when(F.col("next_url").isNull(), "no_next").when(F.lit(step == max_pages), "max_pages"))
        here = _cut(here.select("walk", "step", "url", "hash", F.when(unread.isNull(), F.col("chars")).alias("chars"), "next_url", "urls", "hashes", spent.alias("spent"), stop.alias("stop")))
        rows = here.select("walk", "step", "url", "hash", "chars", "stop")
        done = rows if done is None else done.unionByName(rows)
        more = F.when(F.col("hash").isNotNull(), F.concat("hashes", F.array("hash"))).otherwise(F.col("hashes"))
        at = here.where("stop is null").select("walk", F.col("next_url").alias("url"), F.lit(step + 1).alias("step"), F.concat("urls", F.array("url")).alias("urls"), more.alias("hashes"), "spent")
        if at.limit(1).count() == 0:
            break
    return done
