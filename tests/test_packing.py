"""Packing into chunks against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import blocks, packing


def loop(sizes, target, most):
    parts, now = [], None
    for s in sizes:
        if now is None or now >= target or now + 2 + s > most:
            parts.append(parts[-1] + 1 if parts else 0)
            now = s
        else:
            parts.append(parts[-1])
            now += 2 + s
    return parts


@pytest.mark.parametrize("few", [0, 10, 5000])
def test_packing_is_the_loop(spark, few):
    random.seed(3)
    sections = {k: [random.choice([0, 1, 5, 30, 90, 140]) for _ in range(n)] for k, n in enumerate([1, 2, 7, 40, 700, 1, 90])}
    sections[7] = [200] * 30
    rows = [(k, i, s) for k, v in sections.items() for i, s in enumerate(v)]
    random.shuffle(rows)
    got = packing.packed(spark.createDataFrame(rows, "k int, o int, s int"), ["k"], ["o"], "s", 100, 150, few)
    for k, v in sections.items():
        assert [r.part for r in got.where(F.col("k") == k).orderBy("o").collect()] == loop(v, 100, 150), k


def test_one_very_long_section(spark):
    n = 200_000
    units = spark.range(n).select(F.lit("d").alias("k"), F.col("id").alias("o"), (F.xxhash64("id") % 50 + 50).cast("int").alias("s"))
    sizes = [r.s for r in units.orderBy("o").collect()]
    got = packing.packed(units, ["k"], ["o"], "s", 1200, 1600)
    want = loop(sizes, 1200, 1600)
    assert got.agg(F.max("part"), F.sum("part"), F.count("*")).first() == (max(want), sum(want), n)


def test_last_chunks_join(spark):
    rows = [("k", d, 0, 0, i, f"b{i}", kind, text) for d, own in {"a": [("title", "t"), ("text", "x" * 50), ("text", "y" * 130), ("formula", "z")], "b": [("text", "x" * 100), ("text", "y" * 10)], "c": [("text", "y. " * 100)], "e": [("title", "only")]}.items() for i, (kind, text) in enumerate(own)]
    df = spark.createDataFrame(rows, "kb_id string, document_id string, section long, page_number long, reading_order long, block_id string, type string, text string")
    got = {}
    for r in blocks.chunked(df, 40, 140, 30).orderBy("document_id", "ordinal").collect():
        got.setdefault(r.document_id, []).append(r.block_ids)
    assert got == {"a": [["b0", "b1"], ["b2", "b3"]], "b": [["b0", "b1"]], "c": [["b0"]] * 3, "e": [["b0"]]}
