"""Reading tables and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.sources.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What runs inside passes rows to Python in batches of about `most` bytes; where the caller has set a size, that holds.

    By rows alone a batch is 10,000 texts, which the executor and its worker both hold,
    while its buffers grow even twice.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) is None
    if own:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        if own:
            spark.conf.unset(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(taken: list[str], base: str) -> str:
    """A column name that no column has yet, case aside."""
    low = {c.lower() for c in taken}
    name = base
    while name.lower() in low:
        name = f"_{name}"
    return name


def renamed(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the columns asked for, under those very names, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows (h, n, ...) with the largest counts n, `most` at most.

    A histogram over levels of n, sixteen to an octave, gives the least level whose
    rows still fit, so no task ranks more than its own rows; where even the highest
    level holds too many, or few are asked for, they are ranked by n and h.
    """
    level = F.floor(F.log2("n") * 16)
    if most > 1 << 14:
        sizes = sorted(((r["k"], r["count"]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True)
        total, least = 0, None
        for k, size in sizes:
            if total + size > most:
                break
            total, least = total + size, k
        if least is not None or not sizes:
            return counts.where(level >= (least or 0))
    return counts.orderBy(F.desc("n"), "h").limit(most)
