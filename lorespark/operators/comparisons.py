"""Comparisons: what a second branch contributes, deltas, corpus audits, snapshots, facts in results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.selection import FEW, nearest_ranks


def contribution(gold: DataFrame, vector: DataFrame, graph: DataFrame, hybrid: DataFrame, key: str, k: int = 10) -> DataFrame:
    """One row: how many queries each ranking answers within its first k, and what the graph and the fusion change.

    gold: query_id, key; the rankings: query_id, key, rank. Queries are those with gold. n_improved, n_regressed, n_unchanged compare
    the hybrid with the vector ranking; n_recovered counts gold keys that only the graph has, n_final_recovered those of them in the hybrid.
    """
    first = lambda df, c: df.where(F.col("rank") <= k).select("query_id", key).distinct().withColumn(c, F.lit(1))
    g = gold.select("query_id", key).distinct()
    for df, c in ((vector, "v"), (graph, "g"), (hybrid, "h")):
        g = g.join(first(df, c), ["query_id", key], "left")
    only = F.col("v").isNull() & F.col("g").isNotNull()
    per = g.groupBy("query_id").agg(*[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in "vgh"], F.count_if(only).alias("recovered"), F.count_if(only & F.col("h").isNotNull()).alias("final"))
    some = graph.select("query_id").distinct().withColumn("some", F.lit(True))
    per = per.join(some, "query_id", "left")
    n = lambda cond, name: F.count_if(cond).alias(name)
    v, gr, h = (F.col(c) == 1 for c in "vgh")
    return per.agg(
        F.count("*").alias("n_queries"), n(v, "n_vector"), n(gr, "n_graph"), n(v & gr, "n_both"), n(F.col("some").isNull(), "n_graph_empty"), F.coalesce(F.sum("recovered"), F.lit(0)).alias("n_recovered"),
        F.coalesce(F.sum("final"), F.lit(0)).alias("n_final_recovered"), n(h & ~v, "n_improved"), n(v & ~h, "n_regressed"), n(h == v, "n_unchanged"),
    )


def deltas(df: DataFrame, by: list[str], delta: str, few: int = FEW) -> DataFrame:
    """Aggregates of each group's differences: counts by sign, mean, ends, nearest-rank median and 95th percentile."""
    d = F.col(delta)
    signs = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("n_positive"), F.count_if(d == 0).alias("n_zero"), F.count_if(d < 0).alias("n_negative"), F.round(F.avg(d), 8).alias("mean"), F.round(F.min(d), 8).alias("least"), F.round(F.max(d), 8).alias("most"))
    ranks = nearest_ranks(df, by, delta, {"p50": 0.5, "p95": 0.95}, few).select(*by, F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"))
    return signs.join(ranks, by, "left")


def corpus_audit(parts: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """part, n_expected, n_stored, n_missing, n_unexpected, n_repeated of each pair (expected, stored) of tables with the key."""
    out = None
    for name, (expected, stored) in parts.items():
        e = expected.groupBy(key).agg(F.count("*").alias("e"))
        s = stored.groupBy(key).agg(F.count("*").alias("s"))
        both = e.join(s, key, "full_outer")
        has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
        row = both.agg(F.count_if(has("e")).alias("n_expected"), F.count_if(has("s")).alias("n_stored"), F.count_if(has("e") & ~has("s")).alias("n_missing"), F.count_if(has("s") & ~has("e")).alias("n_unexpected"), F.count_if(F.coalesce(F.col("s"), F.lit(0)) > 1).alias("n_repeated"))
        row = row.select(F.lit(name).alias("part"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of rows that differ between two snapshots of equal columns."""
    rest = sorted(c for c in before.columns if c not in keys)
    state = lambda df, c: df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias(c))
    both = state(before, "b").join(state(after, "a"), keys, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def facts_hold(cases: DataFrame, facts: DataFrame, results: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """case_id, holds of every case: whether each expected fact is found in a result row of its own; null for cases without facts.

    facts: case_id, fact, column, number, string (a row for each column that the fact names; a fact without columns says that there are no rows: one
    row, column null); results: case_id, row, column, number, string. Numbers are equal within the tolerance (relative or absolute), all else exactly.
    Facts take the first row that fits and isn't taken, in order. A result that names a column twice in a row holds nothing.
    """
    asked = facts.where("column is not null").groupBy("case_id", "fact").agg(F.count("*").alias("n"))
    f = facts.where("column is not null").select("case_id", "fact", "column", F.col("number").alias("x"), F.col("string").alias("s"))
    r = results.select("case_id", "row", "column", F.col("number").alias("y"), F.col("string").alias("t"))
    near = F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("x"), F.abs("y")))
    equal = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), near).otherwise(F.col("x").isNull() & F.col("y").isNull() & F.col("s").eqNullSafe(F.col("t")))
    fits = f.join(r, ["case_id", "column"]).where(equal).groupBy("case_id", "fact", "row").agg(F.countDistinct("column").alias("m"))
    fits = fits.join(asked, ["case_id", "fact"]).where("m = n").groupBy("case_id", "fact").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    wanted = asked.join(fits, ["case_id", "fact"], "left").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("fact", "rows"))).alias("facts"))

    def take(used: Column, one: Column) -> Column:
        free = F.get(F.array_except(one["rows"], used), F.lit(0))
        return F.when(used.isNotNull() & free.isNotNull(), F.array_append(used, free))

    kind = f"array<{dict(results.dtypes)['row']}>"
    found = wanted.select("case_id", F.aggregate("facts", F.array().cast(kind), take).isNotNull().alias("found"))
    empty = facts.where("column is null").select("case_id").distinct().withColumn("no_rows", F.lit(True))
    some = results.groupBy("case_id", "row").agg((F.count("*") > F.countDistinct("column")).alias("twice")).groupBy("case_id").agg(F.bool_or("twice").alias("twice"))
    all_ = cases.select("case_id").distinct().join(found, "case_id", "left").join(empty, "case_id", "left").join(some, "case_id", "left")
    none = F.col("found").isNull() & F.col("no_rows").isNull()
    holds = F.coalesce("found", F.lit(True)) & (F.col("no_rows").isNull() | F.col("twice").isNull()) & ~F.coalesce("twice", F.lit(False))
    return all_.select("case_id", F.when(~none, holds).alias("holds"))
