"""Exact order statistics of groups of any size, without sorting or gathering a group.

A group's wanted places are narrowed down in rounds. Each round is one aggregation with partial sums: it counts what lies below and within the bracket
of values that holds a place, and draws splitters from a mergeable sketch of what is within; the next bracket lies between the splitters beside the
place; a splitter's own value is a part of its own. Counts are exact, so a sketch that is off costs a round and never the result. Once a bracket holds few values, or one value only, the place is
read off. Groups that are small from the start are numbered by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.scratch import cut

FEW, SPLITTERS, MOST_SENT = 100_000, 64, 50_000


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column], few: int = FEW) -> DataFrame:
    """by and, for each name, the value at a place (0-based, an expression of n, the number of values) of the group's sorted values. Nulls
    aren't values; groups without any are left out, null groups are groups. A place outside 0 to n - 1 gives null."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("g"), F.col(value).alias("v"))
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("k")) for name, place in places.items()])
    state = sizes.select("g", "n", "lo", "hi", F.explode(wanted).alias("w")).select("g", "n", "lo", "hi", "w.name", "w.k").where("k between 0 and n - 1")
    found = None
    for _ in range(200):
        state = cut(state)
        done = state.where("lo = hi").select("g", "name", F.col("lo").alias("x"))
        ready = state.where("lo <> hi").where(F.col("n") <= few)
        done = done.unionByName(_numbered(rows, ready))
        found = done if found is None else found.unionByName(done)
        state = state.where("lo <> hi").where(F.col("n") > few)
        if state.isEmpty():
            break
        state = _narrowed(rows, state)
    else:
        raise RuntimeError("places have not been found")
    out = sizes.select("g")
    found = found.groupBy("g").pivot("name", list(places)).agg(F.first("x"))
    out = out.withColumn("key", F.to_json("g")).join(found.withColumn("key", F.to_json("g")).drop("g"), "key", "left")
    return out.select("g.*", *places)


def _joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (r) with the state (s) of each wanted place of their group whose bracket they lie in; few states are sent to all rows."""
    known = F.broadcast(state) if state.count() <= MOST_SENT else state
    return rows.alias("r").join(known.alias("s"), F.col("r.g").eqNullSafe(F.col("s.g")) & F.col("r.v").between(F.col("s.lo"), F.col("s.hi")))


def _numbered(rows: DataFrame, state: DataFrame) -> DataFrame:
    """g, name, x of places whose brackets hold few values; k counts from the bracket's least value."""
    w = Window.partitionBy("g", "name").orderBy("v")
    placed = _joined(rows, state).select("s.g", "s.name", "s.k", "r.v").withColumn("place", F.row_number().over(w) - 1)
    return placed.where("place = k").select("g", "name", F.col("v").alias("x"))


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state with smaller brackets: n values from lo to hi, among which the place is k."""
    grid = [i / SPLITTERS for i in range(1, SPLITTERS)]
    drawn = cut(_joined(rows, state).groupBy("s.g", "s.name", "s.k", "s.lo", "s.hi").agg(F.count("*").alias("n"), F.percentile_approx("r.v", grid, 1000).alias("s")))
    at = F.floor(F.col("k") * SPLITTERS / F.col("n")).cast("int")  # splitters at - 1 and at + 1 should enclose the place; indices from 0
    first = F.when(at >= 2, F.get("s", at - 2)).otherwise(F.col("lo"))
    last = F.when(at <= SPLITTERS - 3, F.get("s", at + 1)).otherwise(F.col("hi"))
    drawn = drawn.select("g", "name", "k", "lo", "hi", first.alias("a"), last.alias("z"))
    near = _joined(rows, drawn)
    v, a, z = F.col("r.v"), F.col("s.a"), F.col("s.z")
    part = F.when(v < a, 0).when(v == a, 1).when(v < z, 2).when(v == z, 3).otherwise(4)  # a splitter itself is a part: often many values are equal
    counted = near.withColumn("part", part).groupBy("s.g", "s.name", "s.k", "part").agg(F.count("*").alias("n"), F.min("r.v").alias("lo"), F.max("r.v").alias("hi"))
    parts = counted.groupBy("g", "name", "k").agg(F.array_sort(F.collect_list(F.struct("part", "n", "lo", "hi"))).alias("p"))  # five at most
    kind = "struct<before:long,k:long,n:long,lo:{0},hi:{0}>".format(dict(rows.dtypes)["v"])

    def step(found: Column, p: Column) -> Column:
        here = found["n"].isNull() & (F.col("k") < found["before"] + p["n"])
        new = F.when(here, F.struct((found["before"] + p["n"]).alias("before"), (F.col("k") - found["before"]).alias("k"), p["n"].alias("n"), p["lo"].alias("lo"), p["hi"].alias("hi")))
        on = F.struct((found["before"] + p["n"]).alias("before"), found["k"].alias("k"), found["n"].alias("n"), found["lo"].alias("lo"), found["hi"].alias("hi"))
        return F.coalesce(new, on).cast(kind)

    start = F.struct(F.lit(0).alias("before"), F.lit(None).alias("k"), F.lit(None).alias("n"), F.lit(None).alias("lo"), F.lit(None).alias("hi")).cast(kind)
    return parts.select("g", "name", F.aggregate("p", start, step).alias("f")).select("g", "name", "f.n", "f.lo", "f.hi", "f.k")


def nearest_ranks(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], few: int = FEW) -> DataFrame:
    """by and, for each name, the value at place round((n - 1) * q), halves to even."""
    return order_statistics(df, by, value, {name: F.bround((F.col("n") - 1) * F.lit(float(q))) for name, q in quantiles.items()}, few)


def percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], few: int = FEW) -> DataFrame:
    """by and, for each name, the value at place (n - 1) * q, interpolated between the two beside it."""
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    sides = {f"{name}_{side}": f(place(q)) for name, q in quantiles.items() for side, f in (("a", F.floor), ("z", F.ceil))}
    n = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).withColumn("key", F.to_json(F.struct(*by)))
    found = order_statistics(df, by, value, sides, few).withColumn("key", F.to_json(F.struct(*by))).join(n.select("key", "n"), "key")
    between = lambda name, q: F.col(f"{name}_a") + (F.col(f"{name}_z") - F.col(f"{name}_a")) * (place(q) - F.floor(place(q)))
    return found.select(*by, *[between(name, q).alias(name) for name, q in quantiles.items()])
