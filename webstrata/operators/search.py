"""Search results as rows: JSON answers, scraped result pages, skills and their inputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html, urls
from webstrata.operators import ranking


def json_results(answers: DataFrame, query: str, body: str, provider: str, *, list_path: str = "results", url: str = "url", snippet: str = "content") -> DataFrame:
    """(query, position, title, url, snippet, provider): places count before unusable links are dropped, so gaps stay."""
    item = f"struct<title:string,{url}:string,{snippet}:string>"
    rows = answers.select(query, F.posexplode(F.from_json(F.get_json_object(body, f"$.{list_path}"), f"array<{item}>")).alias("pos", "r"))
    out = rows.select(query, (F.col("pos") + 1).alias("position"), F.coalesce("r.title", F.lit("")).alias("title"), F.col(f"r.{url}").alias("url"), F.coalesce(f"r.{snippet}", F.lit("")).alias("snippet"), F.lit(provider).alias("provider"))
    return usable(out)


def page_results(pages: DataFrame, query: str, body: str, provider: str) -> DataFrame:
    """The same from the markup of a result page; redirect links are unwrapped."""

    kind = pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("snippet", pa.string())]))

    @F.arrow_udf("array<struct<title:string,url:string,snippet:string>>")
    def read(markup: pa.Array) -> pa.Array:
        return pa.array([[{k: r[k] for k in ("title", "url", "snippet")} for r in html.search_results(m or "")] for m in markup.to_pylist()], kind)

    rows = pages.select(query, F.posexplode(read(body)).alias("pos", "r"))
    return usable(rows.select(query, (F.col("pos") + 1).alias("position"), "r.title", urls.unwrap_redirect(F.col("r.url")).alias("url"), "r.snippet", F.lit(provider).alias("provider")))


def usable(results: DataFrame) -> DataFrame:
    """Results with an http(s) address that isn't a private host."""
    return results.where(F.lower("url").rlike("^https?://") & ~urls.is_private_literal(urls.host(F.col("url"))))


def limit_results(n: Column) -> Column:
    """A wished number of results, from 1 to 100."""
    return F.greatest(F.lit(1), F.least(n, F.lit(100)))


def checked_inputs(rows: DataFrame, specs: list[tuple[str, str, bool]], inputs: str = "inputs", extras: int = 20) -> DataFrame:
    """`values` and `problems` of skill inputs. specs: (name, type, required); types string, integer, number, boolean.

    Numbers must be finite; up to `extras` further inputs are kept as they are.
    """
    values, problems = [], []
    for name, kind, required in specs:
        v = F.element_at(inputs, name)
        to = {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(kind)
        cast = v if to is None else v.try_cast(to)
        bad = v.isNotNull() & (cast.isNull() | ((F.isnan(cast) | (F.abs(cast) == float("inf"))) if kind == "number" else F.lit(False)))
        problems += [F.when(bad, F.lit(f"{name}: not a {kind}")), F.when(v.isNull() & F.lit(required), F.lit(f"{name}: missing"))]
        values.append(F.struct(F.lit(name).alias("key"), F.when(~bad, cast.cast("string")).alias("value")))
    known = F.array(*[F.lit(n) for n, _, _ in specs])
    rest = F.slice(F.filter(F.map_entries(inputs), lambda e: ~F.array_contains(known, e["key"])), 1, extras)
    return rows.withColumns({"values": F.map_from_entries(F.concat(F.array(*values), rest)), "problems": F.array_compact(F.array(*problems))})


def captcha_verdict(resolved: Column, method: Column, detail: Column) -> Column:
    """A resolver's answer with its gaps filled: unresolved, method unknown."""
    return F.struct(F.coalesce(resolved, F.lit(False)).alias("resolved"), F.coalesce(method, F.lit("unknown")).alias("method"), detail.alias("detail"))


def accession(url: Column) -> Column:
    """The filing number in a path: ten, two and six digits."""
    return F.regexp_extract(url, r"(\d{10}-\d{2}-\d{6})", 1)


def release_tag(url: Column) -> Column:
    return F.regexp_extract(url, r"/releases/tag/([^/?#]+)", 1)


def engine_results(pages: DataFrame, query: str, body: str, engine: str, order: list[str]) -> DataFrame:
    """Results of the first engine, in the order given, whose result page has any.

    pages: one row per query and engine.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(engine))
    parts = [page_results(pages.where(F.col(engine) == name), query, body, name) for name in order]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumnRenamed("provider", engine).withColumn("rank", rank)
    return ranking.first_provider(ranked, query, "rank").withColumnRenamed(engine, "provider").drop("rank")
