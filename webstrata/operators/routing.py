"""Which way a row goes: binary or page readers, the first fitting file, named skills, rows matched by place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls
from webstrata.operators import search
from webstrata.operators.lookups import host_suffixes


def routed(rows: DataFrame, *, url: str = "url", content_type: str | None = None) -> DataFrame:
    """`kind` by the path's extension, else by the probed content type, and `route`: binary or html."""
    kind = urls.kind_by_extension(F.col(url))
    if content_type:
        probed = urls.kind_by_headers(F.col(content_type), F.lit(None).cast("string"))
        kind = F.when(kind.isNull() | (kind == "unknown"), F.coalesce(probed, kind)).otherwise(kind)
    return rows.withColumn("kind", kind).withColumn("route", F.when(urls.is_binary_kind(F.col("kind")), "binary").otherwise("html"))


def routed_scan(rows: DataFrame, binary: Callable[[DataFrame], DataFrame], html: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Each row through the reader of its route; columns that only one reader gives are null for the other."""
    r = routed(rows, **options)
    return binary(r.where("route = 'binary'")).unionByName(html(r.where("route = 'html'")), allowMissingColumns=True)


def first_file(results: DataFrame, query: str, types: list[str], *, position: str = "position", url: str = "url", probed: str | None = None, deny: list[str] | None = None) -> DataFrame:
    """(query, url, tier): per query the first result with one of the extensions; if there is none, the first
    without any extension whose probed kind is that of one of them. Without such kinds an unknown binary will do.
    """
    exts = [f".{t.lstrip('.').lower()}" for t in types]
    kinds = sorted({urls.EXTENSION_KIND[e] for e in exts if e in urls.EXTENSION_KIND})
    ext = F.col("__ext")
    tier = F.when(ext.isin(exts), 1)
    if probed:
        wanted = F.col(probed).isin(kinds) if kinds else F.col(probed) == "binary_other"
        tier = tier.when((ext == "") & wanted, 2)
    rows = results.withColumns({"__host": urls.host(F.col(url)), "__ext": urls.extension(F.col(url))})
    rows = rows.where(urls.gate_host(F.col("__host"), deny=deny)).withColumn("tier", tier).where("tier is not null")
    best = rows.groupBy(query).agg(F.min_by(F.struct(url, "tier"), F.struct("tier", position)).alias("best"))
    return best.select(query, F.col(f"best.{url}").alias("url"), "best.tier")


def zipped(targets: DataFrame, fetches: DataFrame, by: str, position: str, default: dict[str, object] | None = None) -> DataFrame:
    """Each target with the fetch of the same group and place, or the defaults."""
    out = targets.join(fetches, [by, position], "left")
    return out.fillna(default) if default else out


def in_order(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, repeats kept, with `part`, the number of the table they come from."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


#: Skills by (domain, name): what each makes of a row's url and inputs.
RUNNERS: dict[tuple[str, str], Callable[[Column, Column], Column]] = {
    ("sec.gov", "accession"): lambda url, inputs: F.create_map(F.lit("accession"), search.accession(url)),
    ("github.com", "release"): lambda url, inputs: F.create_map(F.lit("tag"), search.release_tag(url)),
}


def run_skills(calls: DataFrame, key: str, *, url: str = "url", name: str = "skill", inputs: str = "inputs", runners: dict | None = None) -> DataFrame:
    """(key, domain, output, error) of named skills: of the skills of that name the one with the longest matching domain runs.

    error: no_skill where none matches; else null. runners: further skills, or other ones for the same names.
    """
    known = RUNNERS | (runners or {})
    spark = calls.sparkSession
    table = spark.createDataFrame([(d, n) for d, n in known], "domain string, runner string")
    rows = calls.select(key, F.col(url).alias("url"), F.col(name).alias("name"), F.col(inputs).alias("inputs"), urls.host(F.col(url)).alias("host"))
    found = rows.withColumn("d", F.explode(host_suffixes(F.col("host")))).join(F.broadcast(table), (F.col("d") == F.col("domain")) & (F.col("name") == F.col("runner")))
    best = found.groupBy(key).agg(F.max_by("domain", F.length("domain")).alias("domain"))
    met = rows.join(best, key, "left")
    out = F.lit(None).cast("map<string,string>")
    for (d, n), run in known.items():
        out = F.when((F.col("domain") == d) & (F.col("name") == n), run(F.col("url"), F.col("inputs"))).otherwise(out)
    return met.select(key, "domain", out.alias("output"), F.when(F.col("domain").isNull(), "no_skill").alias("error"))


def messages(rows: DataFrame, keys: list[str], tests: Iterable[tuple[Column, str, str, Column]]) -> DataFrame:
    """(keys, code, severity, message): a row for every test (condition, code, severity, message) that a row meets."""
    found = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))) for when, code, severity, message in tests]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("m")).select(*keys, "m.*")


def correlated(rows: DataFrame, cid: str | None = None) -> DataFrame:
    """`correlation_id`: the caller's, or one for all rows of this call."""
    return rows.withColumn("correlation_id", F.lit(cid or uuid.uuid4().hex))
