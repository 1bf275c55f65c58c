"""Fusion of rankings: reciprocal ranks, fair pool, contribution merge, reranking, context packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators.sparse import ranked

BRANCHES = ("dense", "sparse", "graph", "multimodal")
RRF_K, POOL, FINAL, CONTEXT = 60, 80, 20, 6000


def distinct_ranks(ranking: DataFrame, key: str) -> DataFrame:
    """query_id, key, pos (1-based place among distinct keys in first-seen order)."""
    first = ranking.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    return first.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)).alias("pos"))


def _scores(a: DataFrame, b: DataFrame, key: str, k: int, names: tuple[str, str]) -> DataFrame:
    x, y = distinct_ranks(a, key).withColumnRenamed("pos", "pa"), distinct_ranks(b, key).withColumnRenamed("pos", "pb")
    both = x.join(y, ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    source = F.when(F.col("pa").isNull(), names[1]).when(F.col("pb").isNull(), names[0]).otherwise("both")
    return both.select("query_id", key, F.round(part("pa") + part("pb"), 12).alias("score"), source.alias("source"))


def rrf(a: DataFrame, b: DataFrame, key: str, limit: int = FINAL, k: int = RRF_K, names: tuple[str, str] = ("vector", "graph")) -> DataFrame:
    """query_id, key, score, source (one of the names or both), rank: sums of 1 / (k + place) over both rankings."""
    return ranked(_scores(a, b, key, k, names), ["query_id"], [F.desc("score"), F.asc(key)], limit)


def fused_chunks(vector: DataFrame, graph: DataFrame, limit: int = FINAL, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, source, knowledge_base_id, document_id, page_start, page_end, blocks, evidence_ids, rank: chunks of both rankings by rrf.

    Both: query_id, chunk_id, rank, knowledge_base_id, document_id, page_start, page_end, blocks; graph also evidence_id, with a row for each evidence of a chunk.
    A chunk's pages are widened to those of its evidence; its blocks are the vector's, then those of its evidence in order of rank, each once. Order:
    score, knowledge base, document, pages, chunk, blocks, evidence.
    """
    by = ["query_id", "chunk_id"]
    where = F.struct("knowledge_base_id", "document_id")
    v = vector.groupBy(*by).agg(F.min_by(F.struct(where.alias("w"), "page_start", "page_end", "blocks"), F.struct("rank", "page_start", "page_end")).alias("v"))
    g = graph.groupBy(*by).agg(F.min_by(where, F.struct("rank", "evidence_id")).alias("w"), F.min("page_start").alias("a"), F.max("page_end").alias("z"), F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "blocks"))).alias("rows"))
    both = _scores(vector, graph, "chunk_id", k, ("vector", "graph")).join(v, by, "left").join(g, by, "left")
    of = F.coalesce("v.w", "w")
    own = F.coalesce("v.blocks", F.array().cast("array<string>"))
    blocks = F.array_distinct(F.concat(own, F.coalesce(F.flatten(F.transform("rows", lambda x: x["blocks"])), F.array().cast("array<string>"))))
    evidence = F.coalesce(F.array_distinct(F.transform("rows", lambda x: x["evidence_id"])), F.array().cast("array<string>"))
    both = both.select(*by, "score", "source", of["knowledge_base_id"].alias("knowledge_base_id"), of["document_id"].alias("document_id"), F.least("v.page_start", "a").alias("page_start"), F.greatest("v.page_end", "z").alias("page_end"), blocks.alias("blocks"), evidence.alias("evidence_ids"))
    return ranked(both, ["query_id"], [F.desc("score"), *map(F.asc, ("knowledge_base_id", "document_id", "page_start", "page_end", "chunk_id", "blocks", "evidence_ids"))], limit)


def fair_pool(branches: dict[str, DataFrame], key: str, limit: int = POOL, order: tuple[str, ...] = BRANCHES) -> DataFrame:
    """query_id, key, branches, rank: round-robin over the branches, known keys skipped.

    A skipped key still takes its branch's turn, so a key's turn is the least of place * branches + branch.
    """
    n = len(order)
    turns = None
    for i, name in enumerate(order):
        if name in branches:
            one = distinct_ranks(branches[name], key).select("query_id", key, ((F.col("pos") - 1) * n + i).alias("turn"), F.lit(name).alias("branch"))
            turns = one if turns is None else turns.unionByName(one)
    pooled = turns.groupBy("query_id", key).agg(F.min("turn").alias("turn"), F.sort_array(F.collect_set("branch")).alias("branches"))
    return ranked(pooled, ["query_id"], [F.asc("turn")], limit)


def contributions(hits: DataFrame, key: str) -> DataFrame:
    """query_id, key, branch, score, rank, point_id, seed_id, paths, representation_ids, n_hits: the hits of one key in one branch as one.

    hits: query_id, key, branch, score, rank, and as far as there are any point_id, seed_id, paths and representation_ids (arrays). A graph's
    hits give their best score, their least rank, all distinct paths and the seed of the best hit (score, rank, seed); multimodal ones their best score,
    least rank and all representations; of other branches the best hit (score, rank, point) stands.
    """
    kinds = {"point_id": "string", "seed_id": "string", "paths": "array<string>", "representation_ids": "array<string>"}
    hits = hits.select("query_id", key, "branch", "score", "rank", *[(F.col(c) if c in hits.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    first = lambda c: F.min(F.struct((-F.col("score")).alias("s"), "rank", F.coalesce(c, F.lit("")).alias("x"), c))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    got = hits.groupBy("query_id", key, "branch").agg(F.max("score").alias("score"), F.min("rank").alias("least"), first("point_id").alias("p"), first("seed_id").alias("g"), union("paths").alias("paths"), union("representation_ids").alias("representations"), F.count("*").alias("n_hits"))
    graph, many = F.col("branch") == "graph", F.col("branch") == "multimodal"
    none = F.array().cast("array<string>")
    return got.select(
        "query_id", key, "branch", "score", F.when(graph | many, F.col("least")).otherwise(F.col("p.rank")).alias("rank"), F.when(~(graph | many), F.col("p.point_id")).alias("point_id"), F.when(graph, F.col("g.seed_id")).alias("seed_id"),
        F.when(graph, F.col("paths")).otherwise(none).alias("paths"), F.when(many, F.col("representations")).otherwise(none).alias("representation_ids"), "n_hits",
    )


def rerank(candidates: DataFrame, key: str, scorer: Callable[[DataFrame], Column], limit: int = FINAL) -> DataFrame:
    """candidates with final_score (by an injected scorer) and rank: score first, then key; scores that aren't finite are refused."""
    scored = candidates.withColumn("final_score", scorer(candidates))
    bad = F.isnan("final_score") | (F.abs("final_score") == float("inf"))
    scored = scored.withColumn("final_score", F.when(bad, F.raise_error(F.lit("a score is not finite"))).otherwise(F.col("final_score")))
    return ranked(scored.drop("rank"), ["query_id"], [F.desc("final_score"), F.asc(key)], limit)


def lexical_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross encoder: share of the query's distinct tokens that the text has."""
    from lorespark.functions.text import tokens

    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0), 6)


def rerank_text(parts: DataFrame, key: str, most: int = CONTEXT) -> DataFrame:
    """key, text: distinct (type, id, text) in order, joined by line ends and cut."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("type", "id", "text"))).alias("p"))
    return rows.select(key, F.substring(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), 1, most).alias("text"))


def pack_context(items: DataFrame, budget: int = CONTEXT) -> DataFrame:
    """query_id, id, marker, used: items (query_id, id, rank, text, blocks) in rank order, whole or not at all.

    Left out: empty texts, ids seen before, items that share a block with a chosen one and have the same normalised text, and
    texts that don't fit into what is left of the budget (later ones may). A fold over each query's ranked list, which the final cut
    bounds; texts that are empty or alone beyond the budget are never chosen, so they aren't gathered, and no list holds a text of over `budget` characters.
    """
    items = items.where((F.length(F.trim("text")) > 0) & (F.length("text") <= budget))
    norm = F.trim(F.regexp_replace(F.lower(F.col("text")), r"\s+", " "))
    item = F.struct("rank", F.col("id").cast("string").alias("id"), "text", F.transform("blocks", lambda b: b.cast("string")).alias("blocks"), norm.alias("norm"))
    lists = items.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<id:string,blocks:array<string>,norm:string,size:int>>").alias("chosen"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["text"])
        seen = F.exists(s["chosen"], lambda c: (c["id"] == x["id"]) | (F.arrays_overlap(c["blocks"], x["blocks"]) & (c["norm"] == x["norm"])))
        ok = (F.length(F.trim(x["text"])) > 0) & ~F.coalesce(seen, F.lit(False)) & (s["used"] + size <= budget)
        new = F.struct(x["id"].alias("id"), x["blocks"].alias("blocks"), x["norm"].alias("norm"), size.alias("size"))
        return F.struct(F.when(ok, s["used"] + size).otherwise(s["used"]).alias("used"), F.when(ok, F.array_append(s["chosen"], new)).otherwise(s["chosen"]).alias("chosen"))

    packed = lists.select("query_id", F.aggregate("items", start, step)["chosen"].alias("chosen"))
    out = packed.select("query_id", F.posexplode("chosen").alias("i", "c"))
    return out.select("query_id", F.col("c.id").alias("id"), F.concat(F.lit("C"), (F.col("i") + 1).cast("string")).alias("marker"), F.col("c.size").cast("long").alias("n_chars"))


def rendered(packed: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """query_id, context: the chosen texts after their markers, in order."""
    rows = packed.join(texts.select(F.col(key).cast("string").alias("id"), "text"), "id")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.substring("marker", 2, 9).cast("int").alias("i"), F.concat(F.lit("["), "marker", F.lit("] "), "text").alias("t")))).alias("l"))
    return lists.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("context"))
