"""Ranking metrics, comparison of systems, percentiles, rates and usage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = (1, 3, 5, 10)


def distinct_ranking(run: DataFrame, key: str) -> DataFrame:
    """query_id, key, pos: the first occurrence of each key, places counted among distinct ones."""
    first = run.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    return first.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)).cast("long").alias("pos"))


def query_metrics(queries: DataFrame, run: DataFrame, gold: DataFrame, key: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, first_rank, mrr, hit_k, recall_k for every query: rankings are de-duplicated, queries without gold score 0."""
    n_gold = gold.groupBy("query_id").agg(F.countDistinct(key).alias("n_gold"))
    found = distinct_ranking(run, key).join(gold.select("query_id", key).distinct(), ["query_id", key])
    return _measured(queries, found, n_gold, cuts)


def class_metrics(queries: DataFrame, run: DataFrame, items: DataFrame, key: str, label: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_metrics where the gold of a query are the items of its class: queries (query_id, label), items (key, label), each with one label.

    The pairs of queries and their gold, which grow with the square of the input, are never made: classes are counted, and found items are judged by theirs.
    """
    size = items.where(F.col(label).isNotNull()).groupBy(label).agg(F.countDistinct(key).alias("n_gold"))
    n_gold = queries.select("query_id", label).distinct().join(F.broadcast(size), label).select("query_id", "n_gold")
    found = of_class(distinct_ranking(run, key), queries, items, key, label).where("good").drop("good")
    return _measured(queries, found, n_gold, cuts)


def of_class(run: DataFrame, queries: DataFrame, items: DataFrame, key: str, label: str) -> DataFrame:
    """run with good: whether an item is of its query's class."""
    own = queries.select("query_id", F.col(label).alias("_q")).distinct()
    kinds = items.select(key, F.col(label).alias("_i")).distinct()
    both = run.join(own, "query_id", "left").join(kinds, key, "left")
    return both.withColumn("good", F.coalesce(F.col("_q") == F.col("_i"), F.lit(False))).drop("_q", "_i")


def _measured(queries: DataFrame, found: DataFrame, n_gold: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    found = found.groupBy("query_id").agg(F.min("pos").alias("first_rank"), *[F.count_if(F.col("pos") <= k).alias(f"f{k}") for k in cuts])
    df = queries.select("query_id").distinct().join(n_gold, "query_id", "left").join(found, "query_id", "left")
    hit = [F.coalesce((F.col("first_rank") <= k).cast("long"), F.lit(0).cast("long")).alias(f"hit_{k}") for k in cuts]
    recall = [F.coalesce(F.round(F.col(f"f{k}") / F.col("n_gold"), 6), F.lit(0.0)).alias(f"recall_{k}") for k in cuts]
    return df.select("query_id", "first_rank", F.coalesce(F.round(1.0 / F.col("first_rank"), 6), F.lit(0.0)).alias("mrr"), *hit, *recall)


def raw_hits(run: DataFrame, gold: DataFrame, key: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, raw_hit_k over the first K entries as they are, repeated ones included."""
    good = run.join(gold.select("query_id", key).distinct().withColumn("good", F.lit(True)), ["query_id", key], "left")
    return judged_hits(good, cuts)


def judged_hits(run: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """raw_hits of a run that says which entries are good."""
    good = F.coalesce("good", F.lit(False))
    return run.groupBy("query_id").agg(*[F.max((good & (F.col("rank") <= k)).cast("long")).alias(f"raw_hit_{k}") for k in cuts])


def mean_of_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, mean of the columns that no row lacks."""
    one = [F.struct(F.lit(c).alias("name"), F.when(F.count(c) == F.count("*"), F.round(F.avg(c), 6)).alias("mean")) for c in columns]
    return df.agg(F.array(*one).alias("m")).select(F.explode("m").alias("m")).select("m.name", "m.mean").where("mean is not null")


def paired(a: DataFrame, b: DataFrame, columns: list[str], lower_better: tuple[str, ...] = ("first_rank",)) -> DataFrame:
    """metric, improved, unchanged, regressed, mean_delta of b against a on the same queries; a missing rank is worst."""
    x = a.select("query_id", *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select("query_id", *[F.col(c).alias(f"b_{c}") for c in columns]), "query_id")
    rows = []
    for c in columns:
        sign = -1 if c in lower_better else 1
        worst = F.lit(1e18)
        va, vb = (F.coalesce(F.col(f"{s}_{c}").cast("double"), worst if sign < 0 else F.lit(0.0)) * sign for s in "ab")
        delta = F.round(F.avg(F.col(f"b_{c}") - F.col(f"a_{c}")), 6)
        rows.append(F.struct(F.lit(c).alias("metric"), F.count_if(vb > va).alias("improved"), F.count_if(vb == va).alias("unchanged"), F.count_if(vb < va).alias("regressed"), delta.alias("mean_delta")))
    return x.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rank_movement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both_ranked, miss_to_hit, hit_to_miss, earlier, later, same, mean_change of the first relevant rank."""
    x = a.select("query_id", F.col("first_rank").alias("ra")).join(b.select("query_id", F.col("first_rank").alias("rb")), "query_id")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    change = F.when(both, F.col("rb") - F.col("ra"))
    return x.agg(F.count_if(both).alias("both_ranked"), F.count_if(F.col("ra").isNull() & F.col("rb").isNotNull()).alias("miss_to_hit"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNull()).alias("hit_to_miss"), F.count_if(change < 0).alias("earlier"), F.count_if(change > 0).alias("later"), F.count_if(change == 0).alias("same"), F.round(F.avg(change), 6).alias("mean_change"))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place round((n - 1) * q), halves to even, of a column's sorted values; null without values."""
    v = F.array_sort(F.collect_list(values))
    return F.when(F.size(v) > 0, F.element_at(v, (F.bround((F.size(v) - 1) * F.lit(float(q))).cast("int") + 1)))


def summary(value: str) -> list[Column]:
    """sample_count, known_count, total, mean, p50, p95 (interpolated); unknown values are left out."""
    return [F.count("*").alias("sample_count"), F.count(value).alias("known_count"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95")]


def strict_sum(value: str) -> Column:
    """Sum that is unknown if any value is, or if there is none."""
    return F.when((F.count("*") > 0) & (F.count(value) == F.count("*")), F.sum(value))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def cost(tokens_in: Column, price_in: float, tokens_out: Column, price_out: float) -> Column:
    """Price per thousand tokens, to eight places, halves to even; null if a count is missing."""
    return F.bround((tokens_in * price_in + tokens_out * price_out) / 1000, 8)


def tumbling(df: DataFrame, ts: str, minutes: int = 5) -> DataFrame:
    """df with bucket: the start of its interval of minutes; the same expression serves batches and streams."""
    return df.withColumn("bucket", F.window(ts, f"{minutes} minutes").start)


def with_zeroes(counts: DataFrame, key: str, domain: list[str], value: str = "n") -> DataFrame:
    """Counts for every key of the domain, zero where there is none."""
    all_keys = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return all_keys.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0).cast("long")).alias(value))


def branch_recovery(found: DataFrame, branches: list[str]) -> DataFrame:
    """One row from query_id and one boolean a branch: found and only counts, several, none."""
    n = sum((F.col(b).cast("int") for b in branches), F.lit(0))
    cols = [F.count_if(F.col(b)).alias(f"{b}_found") for b in branches] + [F.count_if(F.col(b) & (n == 1)).alias(f"{b}_only") for b in branches]
    return found.agg(*cols, F.count_if(n > 1).alias("several"), F.count_if(n == 0).alias("none"))


def agreement(a: DataFrame, b: DataFrame, key: str, k: int = 10) -> DataFrame:
    """One row: queries, same_order (share with identical first k), overlap (mean share of common ones)."""
    one = lambda df, c: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias(c))
    both = one(a, "x").join(one(b, "y"), "query_id")
    overlap = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    return both.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("same_order"), F.round(F.avg(overlap), 6).alias("overlap"))


def coverage(n_found: Column, n_gold: Column) -> Column:
    return F.when(n_found == 0, "none").when(n_found >= n_gold, "complete").otherwise("partial")


def nearly_equal(a: Column, b: Column) -> Column:
    """Within 1e-6, or 1e-9 of the larger one."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows as often, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
