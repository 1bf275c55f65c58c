"""Indexes of immutable partitions."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import manifests

C = {"v": 1}


def rows_of(spark, n, per=5, mark="old"):
    return spark.range(n * per).select((F.col("id") % n).cast("string").alias("document_id"), F.col("id").alias("x"), F.sha2(F.concat("id", F.lit(mark)), 512).alias("text"))


def size(path, since=()):
    return sum(p.stat().st_size for p in path.rglob("*.parquet") if p not in since)


def test_a_document_costs_its_bucket(spark, tmp_path):
    written = []
    for n in (500, 5000):
        at = tmp_path / str(n)
        index = manifests.Index(spark, f"file://{at}")
        index.build({"chunks": rows_of(spark, n)}, C, bucket_rows=250)
        before = set(at.rglob("*.parquet"))
        new = rows_of(spark, n, mark="new").where("document_id = '7'")
        index.replace({"chunks": new}, C)
        written.append(size(at, before))
        got = index.read("chunks", ["7"])
        assert {r.text for r in got.collect()} == {r.text for r in new.collect()} and index.read("chunks").count() == 5 * n
        assert len(got.inputFiles()) == 1 < len(index.read("chunks").inputFiles())
    assert 0 < written[1] < 2 * written[0]


def test_two_writers(spark, tmp_path):
    a, b = (manifests.Index(spark, f"file://{tmp_path}") for _ in range(2))
    a.build({"chunks": rows_of(spark, 20), "evidence": rows_of(spark, 20)}, C, bucket_rows=10)
    one = rows_of(spark, 20, mark="b").where("document_id = '3'")

    def meanwhile(tables):
        a.replace({"chunks": rows_of(spark, 20, mark="a").where("document_id = '3'")}, C)

    files = set(tmp_path.rglob("*.parquet"))
    with pytest.raises(manifests.Conflict):
        b.replace({"chunks": one, "evidence": one}, C, check=meanwhile)
    first = a.read("chunks", ["3"]).orderBy("x").first().text
    assert first == rows_of(spark, 20, mark="a").where("document_id = '3'").orderBy("x").first().text and a.read("evidence").count() == 100
    assert len(set(tmp_path.rglob("*.parquet")) - files) == 1  # what the second had written is gone


def test_states_are_whole(spark, tmp_path):
    index = manifests.Index(spark, f"file://{tmp_path}")
    assert index.read("chunks") is None
    index.build({"chunks": rows_of(spark, 20), "evidence": rows_of(spark, 20)}, C, bucket_rows=10)
    mine = rows_of(spark, 20).where("document_id = '3'")

    def refuse(tables):
        raise ValueError("no")

    for bad in (lambda: index.replace({"chunks": mine}, {"v": 2}), lambda: index.replace({"chunks": mine}, C, check=refuse), lambda: index.replace({"chunks": mine.drop("x")}, C), lambda: index.replace({"chunks": mine}, C, ["4"]), lambda: index.replace({"chunks": mine.withColumn("x", F.lit(4).cast("long"))}, C, unique={"chunks": "x"}), lambda: index.replace({"chunks": mine.withColumn("x", F.lit(999).cast("long"))}, C, unique={"chunks": "x"})):
        with pytest.raises(ValueError):
            bad()
    assert index.numbers() == [1]
    index.replace({"chunks": mine.withColumn("x", F.col("x") + 1000), "evidence": mine.limit(0)}, C, ["3"], unique={"chunks": "x"})
    assert (index.read("chunks", ["3"]).agg(F.min("x")).first()[0], index.read("evidence", ["3"]).count(), index.read("evidence").count()) == (1003, 0, 95)
    index.delete(["5", "nobody"], C)
    assert (index.read("chunks").count(), index.read("evidence").count()) == (95, 90)
    (tmp_path / "numbers" / "000000004").touch()  # a writer that died before it was done
    assert index.manifest()[0] == 3 and index.roll_back(1) == 5 and index.read("chunks").count() == 100
    assert index.prune(1) > 0 and index.read("evidence").count() == 100


def test_empty_tables(spark, tmp_path):
    index = manifests.Index(spark, f"file://{tmp_path}")
    index.build({"chunks": rows_of(spark, 1).limit(0)}, C)
    assert index.read("chunks").count() == 0
    index.replace({"chunks": rows_of(spark, 2)}, C)
    assert index.read("chunks").count() == 10 and index.read("chunks", []).count() == 0
