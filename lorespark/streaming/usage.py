"""The usage ledger as a stream: tumbling buckets with a watermark, the same plan as in batches; incremental index upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def buckets(events: DataFrame, minutes: int = 5, late: str | None = None, kind: str = "error") -> DataFrame:
    """bucket, attempts, value: failed attempts by interval. With `late`, events that come later than that are left out."""
    failed = events.where(F.col("event_type") == kind)
    failed = failed.withWatermark("ts", late) if late else failed
    window = F.window("ts", f"{minutes} minutes")
    return failed.groupBy(window.alias("w")).agg(F.count("*").alias("attempts"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("bucket"), "attempts", "value")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upserts(chunks: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands each batch of chunks, the last version of each, to `apply`."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("document_id", "chunk_id").agg(F.max_by(F.struct("version", "text"), "version").alias("r"))
        apply(last.select("document_id", "chunk_id", "r.version", "r.text"), number)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FAILURES = "run_id string, seq long, signature string, retryable boolean"


def breaker(failures: DataFrame, times: int = 3) -> DataFrame:
    """run_id, signature, seq of a stream of failures (FAILURES): each run is stopped once, at the failure that makes the same non-retryable one `times` in a
    row. What a run has had so far is state of the query, so failures in a row may come in different micro-batches, before and after a
    restart from its checkpoint. Within a batch a run's failures are taken by seq; a run that has been stopped needs no more than that state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, n, stopped = state.get if state.exists else (None, 0, False)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for signature, retryable, seq in zip(rows["signature"], rows["retryable"], rows["seq"], strict=True):
            signature = None if pd.isna(signature) else signature
            if stopped:
                break
            known, n = signature, (n if signature == known else 0) + (not retryable)
            if n >= times:
                stopped = True
                yield pd.DataFrame({"run_id": [key[0]], "signature": [signature], "seq": [seq]})
        state.update((known, int(n), stopped))

    kind = "run_id string, signature string, seq long"
    return failures.groupBy("run_id").applyInPandasWithState(step, kind, "signature string, n long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def blocked_runs(failures: DataFrame, times: int = 3) -> DataFrame:
    """run_id, signature of runs to stop: the same non-retryable failure `times` in a row."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id").orderBy("seq")
    changed = (F.col("signature") != F.lag("signature").over(w)) | F.lag("signature").over(w).isNull()
    runs = failures.withColumn("island", F.sum(changed.cast("long")).over(w))
    return runs.where("not retryable").groupBy("run_id", "signature", "island").agg(F.count("*").alias("n")).where(F.col("n") >= times).select("run_id", "signature").distinct()
