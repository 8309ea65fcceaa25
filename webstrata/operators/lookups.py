"""Look-ups: longest matching domain, left look-ups with defaults, overrides by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls


def host_suffixes(host):
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suffix_matches(rows: DataFrame, table: DataFrame, host: str, domain: str) -> DataFrame:
    """Rows with every entry whose domain is the host or a parent of it: an equi-join on suffixes, no nested loop."""
    return rows.withColumn("__d", F.explode(host_suffixes(F.col(host)))).join(table.withColumnRenamed(domain, "__d"), "__d").withColumnRenamed("__d", domain)


def longest_suffix(rows: DataFrame, table: DataFrame, key: str, host: str, domain: str) -> DataFrame:
    """Of each row's matches the one with the longest domain; rows without a match are left out."""
    found = suffix_matches(rows, table, host, domain)
    cols = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*cols), F.length(domain)).alias("__m")).select(key, *[F.col(f"__m.{c}").alias(c) for c in cols])


def left_default(rows: DataFrame, table: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Every row with the looked-up value, or the default."""
    return rows.join(table, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def override(*sources: DataFrame, keys: list[str]) -> DataFrame:
    """The union of tables; of rows with equal keys that of the last table stays."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    rest = [c for c in out.columns if c not in keys and c != "__rank"]
    best = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__rank").alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def cookies_for(rows: DataFrame, cookies: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, name, value, domain): cookies that may go with a request.

    Their domain is the host or a parent of it; a cookie without a domain, or with a
    null one, belongs to the host; a secure one goes with https only.
    cookies: (name, value, domain, secure).
    """
    asked = rows.select(key, urls.host(F.col(url)).alias("host"), F.lower(F.col(url)).startswith("https:").alias("https")).where("host <> ''")
    jar = cookies.select("name", "value", F.lower(F.regexp_replace(F.coalesce("domain", F.lit("")), r"^\.+", "")).alias("domain"), F.coalesce("secure", F.lit(False)).alias("secure"))
    ends = asked.withColumn("d", F.explode(F.concat(F.array(F.lit("")), host_suffixes(F.col("host")))))
    met = ends.join(jar.withColumnRenamed("domain", "d"), "d").where(F.col("https") | ~F.col("secure"))
    return met.select(key, "name", "value", F.when(F.col("d") == "", F.col("host")).otherwise(F.col("d")).alias("domain"))
