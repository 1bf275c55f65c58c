"""Order statistics against sorted lists."""

import random

import numpy as np
from pyspark.sql import functions as F

from lorespark.operators import selection


def test_places_of_every_kind_of_group(spark):
    random.seed(4)
    groups = {"normal": [random.gauss(0, 1) for _ in range(900)], "tail": [10.0 ** random.uniform(-300, 300) for _ in range(700)], "same": [5.0] * 600, "two": [1.0] * 300 + [2.0] * 301, "mostly": [0.0] * 500 + [random.random() for _ in range(200)], "one": [3.5], None: [float(i) for i in range(50)], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    q = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95}
    for few in (20, 10_000):
        got = {r.g: tuple(r)[1:] for r in selection.nearest_ranks(df, ["g"], "v", q, few).collect()}
        assert got == {g: tuple(sorted(vs)[round((len(vs) - 1) * p)] for p in q.values()) for g, vs in groups.items() if vs}
    got = {r.g: tuple(r)[1:] for r in selection.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, 20).collect()}
    for g, vs in groups.items():
        assert not vs or np.allclose(got[g], np.percentile(vs, [50, 95]), rtol=1e-9)
    assert "none" not in got


def test_one_large_group(spark):
    n = 3_000_000
    df = spark.range(n, numPartitions=8).select(F.lit(1).alias("g"), (F.xxhash64("id") % 1_000_003).alias("v"))
    got = selection.nearest_ranks(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, few=1000).first()
    values = np.sort(np.array(df.select("v").toPandas()["v"]))
    assert (got.p50, got.p95) == tuple(values[round((n - 1) * q)] for q in (0.5, 0.95))
