"""Connected components of links, as joins: large-star and small-star rounds, each cut off as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for each node of a link that isn't its component's smallest.

    Minima are pre-aggregated. Links of nodes with very many of them stay where they are and get the minimum from a broadcast (as
    such a node has more than HEAVY links and a SHARE of all, there are 2 * SHARE of them at most); all others join by node.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = common.written(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "links")
    seen = _sum(edges)
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_minimum(both.where("v > u"), low, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_minimum(large, low, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = common.written(small, "small-star")
        if (now := _sum(edges)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


HEAVY, SHARE = 10_000, 50_000


def with_minimum(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """edges (u, v) with the minimum m of u; low: u, m, n (links of u)."""
    limit = max(HEAVY, n_edges // SHARE)
    if n_edges <= limit:
        return edges.join(low.drop("n"), "u")
    low = common.written(low, "minima")
    heavy = F.broadcast(low.where(F.col("n") > limit).drop("n"))
    light = edges.join(heavy.select("u"), "u", "left_anti").join(low.where(F.col("n") <= limit).drop("n"), "u")
    return edges.join(heavy, "u").unionByName(light)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("v")).first())
