"""Table scans: Parquet by name, with declared schemas for the JSON inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement whose {tables} are scans; no view is registered, so sessions with several paths don't mix."""
    used = {n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)
