"""The folder that all executors share, for tables written in between."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a folder of our own, in local mode only."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not (where := getattr(spark.sparkContext, "_lorespark_folder", None)):
        own = tempfile.mkdtemp(prefix="lorespark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = spark.sparkContext._lorespark_folder = f"file://{own}"
    return where


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: what several parts of a plan read is made once, and lost executors can read it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
