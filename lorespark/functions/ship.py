"""This package for the executors' Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context, should it not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_lorespark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="lorespark-")) / "lorespark.zip"  # executors fetch it from here while the driver runs
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._lorespark_shipped = True
