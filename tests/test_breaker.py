"""The circuit breaker as a stream with state."""

from lorespark.streaming import usage


def test_failures_in_a_row_across_batches_and_restarts(spark, tmp_path):
    spark.sql("SELECT 1").collect()
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))

    def add(*rows):
        spark.createDataFrame([(*r, False) if len(r) == 3 else r for r in rows], usage.FAILURES).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(usage.FAILURES).option("maxFilesPerTrigger", 1).parquet(source)
        query = usage.breaker(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.run_id, r.signature, r.seq) for r in spark.read.schema("run_id string, signature string, seq long").parquet(target).collect())

    add(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x", True), ("d", 2, "y"), ("d", 1, "x"))
    add(("a", 2, "x"), ("b", 2, "y"), ("c", 2, "x"), ("e", 1, "z"), ("e", 3, "z"), ("e", 2, "z"))
    assert run() == [("e", "z", 3)]
    add(("a", 3, "x"), ("b", 3, "x"), ("c", 3, "x"), ("e", 4, "z"))
    assert run() == [("a", "x", 3), ("e", "z", 3)]
    add(("b", 4, "x"), ("c", 4, "x"), ("a", 4, "x"), ("b", 5, "x"))
    assert run() == [("a", "x", 3), ("b", "x", 5), ("c", "x", 4), ("e", "z", 3)]
