"""The corpus pipeline: from raw documents to sharded training data, in five stages.

Each stage gets what the one before it kept, in the columns of `documents`; the last
adds the shard. Rows that a stage keeps are never dropped later for anything but
that stage's own rule:

1. language identification: documents without text or without a letter go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. benchmark decontamination: contaminated documents go;
4. mixing: documents become the rows of the mix, repeated or cut to the words taken;
5. sharding: every row gets its shard and slot.

Every stage accepts nulls, empty tables and further columns; what happens to them
is told in the operators' own modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import decontam, lang_id, mixing, ngram_join, sharding
from webstrata.llm._io import free_name, remove, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; `lang` becomes what is predicted where it was null."""
    model = lang_id.train(docs)
    pred, score = (free_name(docs.columns, x) for x in ("lang_pred", "lang_score"))
    found = lang_id.identify(docs, model, pred=pred, score=score).where(F.col(pred) != "und")
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, 40)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages draw from models and permutations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    A stage's folder goes when the next one's is written; the last one stays, as the
    result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before:
                remove(spark, before)
            before = here
    return docs
