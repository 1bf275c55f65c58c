"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.functions.ship import shipped
from lorespark.plans import candidates, documents, evaluation, graphs, lifecycle, relational, retrieval

MODULES = (relational, retrieval, documents, graphs, evaluation, lifecycle, candidates)


def _with_package(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {name: _with_package(f) for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: text for m in MODULES for name, text in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["entry_metrics"](spark, sf_dir)
