"""Event frames of an answer that is streamed: text in server-sent form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(event: Column, data: Column) -> Column:
    """One frame: the event's name, its data line by line, an empty line."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, r"\r?\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def answer_frames(tokens: DataFrame, citations: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """query_id, seq, frame: an answer_delta for each token (query_id, seq, text), then its citations (query_id, citation; sorted, distinct, perhaps none),
    then complete with the number of deltas. An answer that fails (failures: query_id, after, code) has its tokens up to that place, then an error, and ends."""
    if failures is not None:
        tokens = tokens.join(failures.select("query_id", "after"), "query_id", "left").where("after is null or seq <= after").drop("after")
    delta = tokens.select("query_id", F.col("seq").cast("long").alias("seq"), frame(F.lit("answer_delta"), F.to_json(F.struct("text"))).alias("frame"))
    last = tokens.groupBy("query_id").agg(F.max("seq").cast("long").alias("last"), F.count("*").alias("n"))
    failed = None
    if failures is not None:
        failed = failures.join(last, "query_id", "left").select("query_id", (F.coalesce("last", F.lit(-1).cast("long")) + 1).alias("seq"), frame(F.lit("error"), F.to_json(F.struct("code"))).alias("frame"))
        last = last.join(failures, "query_id", "left_anti")
    cited = last.join(citations.groupBy("query_id").agg(F.sort_array(F.collect_set("citation")).alias("citations")), "query_id", "left")
    named = F.to_json(F.struct(F.coalesce("citations", F.array().cast("array<string>")).alias("citations")))
    ends = cited.select("query_id", F.inline(F.array(F.struct((F.col("last") + 1).alias("seq"), frame(F.lit("citations"), named).alias("frame")), F.struct((F.col("last") + 2).alias("seq"), frame(F.lit("complete"), F.to_json(F.struct("n"))).alias("frame")))))
    out = delta.unionByName(ends)
    return out if failed is None else out.unionByName(failed)
