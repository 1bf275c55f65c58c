"""Greedy packing of ordered units into chunks as windows and pointer doubling, so that a section of any length is packed without a list in one row.

In running sums of sizes, where a chunk that begins at a unit ends is a matter of two values: the first sum that reaches the target, and the last that stays
below the most. Both are range frames over the sums. That gives each unit the start of the chunk after its own; the starts that are in fact reached
from the first unit are found in rounds that double the jumps: after r rounds the first 2^r starts are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.scratch import cut

JOINT = 2  # characters between two units of a chunk
FEW = 2000


def next_starts(units: DataFrame, by: list[str], order: list[str], size: str, target: int, most: int) -> DataFrame:
    """units with i (place from 0), n (units of the section) and next: where the chunk after one that begins here would begin, n if there is none.

    A chunk ends before a unit if it has `target` characters already, or would have more than `most` with it; it has one unit at least.
    """
    step = F.col(size) + JOINT
    w = Window.partitionBy(*by).orderBy(*order)
    placed = units.withColumns({"i": F.row_number().over(w) - 1, "_p": F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.count("*").over(Window.partitionBy(*by))})
    ends = units.groupBy(*by).agg(F.count("*").alias("i"), F.sum(step).alias("_p"))
    both = placed.unionByName(ends.withColumn("n", F.col("i")), allowMissingColumns=True)
    frame = Window.partitionBy(*by).orderBy("_p")
    full = F.col("i") + F.count("*").over(frame.rangeBetween(0, target + JOINT - 1))
    over = F.col("i") + F.count("*").over(frame.rangeBetween(0, most + JOINT)) - 1
    found = both.withColumn("next", F.least("n", full, F.greatest(over, F.col("i") + 1)))
    return found.where("i < n").drop("_p")


def reached(jumps: DataFrame, by: list[str]) -> DataFrame:
    """by, i: the starts that are reached from place 0; jumps: by, i, n, next."""
    starts = cut(jumps.where("i = 0").select(*by, "i"))
    jump = cut(jumps.where("next < n").select(*by, "i", "next"))
    while not jump.isEmpty():
        further = starts.join(jump, [*by, "i"]).select(*by, F.col("next").alias("i"))
        starts = cut(starts.unionByName(further))  # disjoint: the first 2^r starts and as many after them
        twice = jump.join(jump.select(*by, F.col("i").alias("next"), F.col("next").alias("_n")), [*by, "next"])
        jump = cut(twice.select(*by, "i", F.col("_n").alias("next")))
    return starts


def walked(jumps: DataFrame, by: list[str]) -> DataFrame:
    """As reached, for sections of few units: one pass over the list of a section's jumps."""
    kind = "struct<at:long,starts:array<long>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("starts")).cast(kind)
    step = lambda s, x: F.when(x["i"] == s["at"], F.struct(x["next"].alias("at"), F.array_append(s["starts"], x["i"]).alias("starts")).cast(kind)).otherwise(s)
    own = jumps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("next").cast("long").alias("next")))).alias("a"))
    return own.select(*by, F.explode(F.aggregate("a", start, step)["starts"]).alias("i"))


def packed(units: DataFrame, by: list[str], order: list[str], size: str, target: int, most: int, few: int = FEW) -> DataFrame:
    """units with part, the number of their chunk in the section, from 0. Sections of up to `few` units, which a row can hold, are walked; longer ones
    are packed by doubling."""
    found = cut(next_starts(units, by, order, size, target, most))
    jumps = found.select(*by, "i", "n", "next")
    long = jumps.where(F.col("n") > few)
    starts = walked(jumps.where(F.col("n") <= few), by)
    if not long.isEmpty():
        starts = starts.unionByName(reached(long, by))
    marked = found.join(starts.where("i > 0").withColumn("_start", F.lit(1)), [*by, "i"], "left")
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("part", F.sum(F.coalesce("_start", F.lit(0))).over(w)).drop("i", "n", "next", "_start")
