"""Session with the settings the operators assume, and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "quillwork", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    return builder.config(map=SETTINGS | more).getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes and rows of one Arrow batch, so that a Python worker's memory does not grow with its partition or with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone become UTC timestamps, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})
