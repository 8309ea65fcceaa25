"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a time-zoned `ts`, as watermarks need it, and microseconds as `us`."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("us", F.unix_micros("ts"))
