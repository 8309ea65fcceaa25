"""Schema-guided fields: for each asked field the first source with a matching key and a value.

A page is parsed once and gives rows (source, place, name, value). Each meets the asked
fields, a table of `max_fields` rows at most, and the least (source, tier, place) of a
field gives its value: a minimum, which is formed before the one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import text as tx

# Names that mean the same; the order of sources.
ALIASES = [
    ["price", "cost", "amount", "pricing"],
    ["name", "title", "product", "headline", "productname"],
    ["author", "by", "writer", "creator", "byline"],
    ["date", "published", "publisheddate", "datepublished", "pubdate"],
    ["description", "summary", "desc", "about", "abstract"],
    ["sku", "id", "productid", "itemid", "mpn"],
    ["rating", "stars", "score", "ratingvalue"],
    ["brand", "manufacturer", "make", "vendor"],
    ["image", "photo", "picture", "thumbnail", "img"],
    ["currency", "pricecurrency"],
]
NAMES = ["json-ld", "opengraph", "meta", "microdata", "dom"]


def schema_table(spark: SparkSession, schema: dict[str, str] | list[str], max_fields: int = 50) -> DataFrame:
    """(field, pos, tokens, aliases, axes, hints) of the asked fields; hints are words of their descriptions."""
    items = list((schema if isinstance(schema, dict) else {f: "" for f in schema}).items())[:max_fields]
    rows = spark.createDataFrame([(f, d, i) for i, (f, d) in enumerate(items)], "field string, described string, pos int")
    norm = tx.normalize_name(F.col("field"))
    tokens = tx.name_tokens(norm)
    groups = F.array(*[F.array(*[F.lit(x) for x in g]) for g in ALIASES])
    axes = F.filter(groups, lambda g: F.arrays_overlap(g, F.col("tokens")))
    rows = rows.withColumn("norm", norm).withColumn("tokens", tokens).withColumn("axes", axes)
    return rows.withColumn("aliases", F.array_union("tokens", F.flatten("axes"))).withColumn("hints", tx.name_tokens(tx.normalize_name(F.regexp_replace("described", r"[^A-Za-z0-9]+", " ")))).drop("described")


def resolve(pages: DataFrame, fields: DataFrame, key: str, max_chars: int = 4000) -> DataFrame:
    """(key, field, value, number, source): one row per page and field; value and source are null if unresolved."""
    s = pages.select(key, F.explode_outer("signals.fields").alias("e")).select(key, "e.*").withColumn("ktokens", tx.name_tokens(F.col("name")))
    text, number = tx.coerce(F.col("value"), max_chars)
    s = s.withColumns({"text": text, "number": number})
    small = (F.size("tokens") > 1) | (F.size("ktokens") <= 2)
    axis = F.exists("axes", lambda g: F.arrays_overlap(g, F.col("ktokens")))
    common = F.size(F.array_intersect("ktokens", F.array_union("tokens", "hints")))
    tier = (
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", None)
        .when(F.col("name") == F.col("norm"), 1)
        .when(small & F.arrays_overlap("ktokens", "aliases") & (F.arrays_overlap("ktokens", "tokens") | axis), 2)
        .when(small & (F.size(F.array_except("tokens", "ktokens")) == 0), 3)
        .when(small & (common > 0), 4)
    )
    met = s.crossJoin(F.broadcast(fields)).withColumn("tier", tier).withColumn("shared", F.when(F.col("tier") == 4, -common).otherwise(0))
    best = F.min(F.when(F.col("tier").isNotNull(), F.struct("rank", "tier", "shared", "place", "text", "number")))
    found = met.groupBy(key, "field", "pos").agg(best.alias("best"))
    names = F.array(*[F.lit(n) for n in NAMES])
    return found.select(key, "field", "pos", F.col("best.text").alias("value"), F.col("best.number").alias("number"), F.get(names, F.col("best.rank")).alias("source"))


def unresolved(resolved: DataFrame, key: str) -> DataFrame:
    return resolved.where("value is null").select(key, "field")


def with_extractor(resolved: DataFrame, pages: DataFrame, key: str, content: str, extractor) -> DataFrame:
    """Fills unresolved fields from a scalar function (field, content) -> text; such values have source `llm`."""
    open_ = resolved.where("value is null").drop("value", "number", "source").join(pages.select(key, content), key)
    text, number = tx.coerce(extractor(F.col("field"), F.col(content)))
    filled = open_.withColumns({"value": text, "number": number}).withColumn("source", F.when(F.col("value").isNotNull(), "llm")).drop(content)
    return resolved.where("value is not null").unionByName(filled.select(*resolved.columns))
