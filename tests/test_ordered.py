"""Runs in file order and logs with torn ends."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.sources import ordered


def written(spark, path, files):
    for i, keys in enumerate(files):
        spark.createDataFrame([(k, j) for j, k in enumerate(keys)], "k string, j int").coalesce(1).write.mode("overwrite").parquet(f"{path}/t{i:02}")
    return spark.read.option("recursiveFileLookup", True).parquet(str(path)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def plain_runs(keys):
    out = []
    for k in keys:
        if out and out[-1][0] == k:
            out[-1][1] += 1
        else:
            out.append([k, 1])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_runs_across_files_and_blocks(spark, tmp_path, block):
    random.seed(block)
    files = [["a"] * 3, ["a", "a", "b"], ["b"], ["b"] * 4 + ["c", None, None], [None, "d"], [random.choice("de") for _ in range(9)]]
    rows = written(spark, tmp_path, files)
    got = sorted(((r.k, r.n) for r in ordered.runs(rows, "k", block).collect()), key=repr)
    assert got == plain_runs([k for f in files for k in f])


def test_a_key_that_comes_back(spark, tmp_path):
    assert ordered.contiguous_rows(written(spark, tmp_path / "a", [["a", "a"], ["a", "b"]]), "k").count() == 4
    with pytest.raises(ValueError, match="b comes back"):
        ordered.contiguous_rows(written(spark, tmp_path / "b", [["b", "a"], ["c"], ["b"]]), "k")


def test_torn_logs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "TAIL", 8)
    (tmp_path / "1.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3, "b": "cut o')
    (tmp_path / "2.jsonl").write_text('{"a": 4}\n\n{"a": 5}')
    (tmp_path / "3.jsonl").write_text("")
    log = ordered.Log(spark, f"file://{tmp_path}")
    assert sorted(v for _, v in log.torn().values()) == [b'{"a": 3, "b": "cut o', b'{"a": 5}']
    read = lambda: sorted(r.a for r in log.read("a long, b string").collect())
    assert read() == [1, 2, 4, 5]
    assert log.repair() == 2 and not log.torn() and read() == [1, 2, 4, 5]
    assert (tmp_path / "1.jsonl").read_text() == '{"a": 1}\n{"a": 2}\n' and (tmp_path / "2.jsonl").read_text() == '{"a": 4}\n\n{"a": 5}\n'
    (tmp_path / "2.jsonl").write_text('{"a": 4}\nnot json\n{"a": 5}\n')
    with pytest.raises(Exception, match="bad line"):
        log.read("a long, b string").collect()
    assert ordered.Log(spark, f"file://{tmp_path}/none").torn() == {}
