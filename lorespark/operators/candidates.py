"""Candidates of several branches: mandatory filters, lineage audits, evidence in its chunk, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T


def scoped(index: DataFrame, knowledge_base: str, document: str | None = None, modality: str = "all", searchable: bool = True, quarantined: bool = False) -> DataFrame:
    """Rows of a knowledge base (which must be named), perhaps of one document and modality; by default searchable ones that
    aren't quarantined. Plain comparisons, so they reach the scan, and the partitions where the index is partitioned by knowledge_base_id."""
    if not knowledge_base:
        raise ValueError("a knowledge base must be named")
    out = index.where(F.col("knowledge_base_id") == knowledge_base)
    out = out if document is None else out.where(F.col("document_id") == document)
    out = out if modality == "all" else out.where(F.col("modality") == modality)
    out = out.where("searchable") if searchable else out
    return out if quarantined else out.where(~F.coalesce(F.col("quarantined"), F.lit(False)))


def with_text(items: DataFrame, text: str = "text") -> DataFrame:
    """Items that have something to read."""
    return items.where(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0)


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule (code, condition) that holds, null if none does."""
    out = F.lit(None).cast("string")
    for code, holds in reversed(rules):
        out = F.when(holds, F.lit(code)).otherwise(out)
    return out


def question_rules(text: Column, least: int = 8, most: int = 400) -> list[tuple[str, Column]]:
    """Quality gates of a question that hold in any language, in their order."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return [
        ("blank", F.coalesce(F.length(plain), F.lit(0)) == 0),
        ("too_short", F.length(plain) < least),
        ("too_long", F.length(plain) > most),
        ("no_letters", ~plain.rlike(r"\p{L}")),
        ("repetitive", F.size(F.array_distinct(T.tokens(plain))) * 4 < F.size(T.tokens(plain))),
    ]


def missing_lineage(scores: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """Scored keys without a lineage row."""
    return scores.join(lineage.select(key), key, "left_anti")


def with_lineage(scores: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """scores with the lineage's columns; a key without lineage is a corrupt index and fails the query."""
    known = lineage.withColumn("_known", F.lit(True))
    out = scores.join(known, key, "left")
    ok = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no lineage for "), F.col(key).cast("string"))))
    return out.withColumn(key, ok).drop("_known")


def in_its_chunk(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence (chunk_id, page_start, page_end, blocks, path) with the chunk's columns (c_) and fault: absent, page, block or path;
    null where its pages and blocks lie in the chunk's, and its path, if it has one, is the chunk's."""
    c = chunks.select("chunk_id", *[F.col(x).alias(f"c_{x}") for x in ("page_start", "page_end", "blocks", "path")])
    out = evidence.join(c, "chunk_id", "left")
    rules = [
        ("absent", F.col("c_page_start").isNull()),
        ("page", (F.col("page_start") < F.col("c_page_start")) | (F.col("page_end") > F.col("c_page_end"))),
        ("block", F.size(F.array_except("blocks", "c_blocks")) > 0),
        ("path", (F.coalesce(F.length("path"), F.lit(0)) > 0) & ~F.col("path").eqNullSafe(F.col("c_path"))),
    ]
    return out.withColumn("fault", first_failing(rules))


def best_match(matches: DataFrame, key: str) -> DataFrame:
    """The best graph match (score, hop, rank, seed_id, evidence_id) of each query_id and key: score, fewer hops, rank, seed, evidence."""
    order = F.struct((-F.col("score")).alias("s"), "hop", "rank", "seed_id", "evidence_id")
    best = matches.groupBy("query_id", key).agg(F.min(order).alias("b"))
    return best.select("query_id", key, (-F.col("b.s")).alias("score"), "b.hop", "b.rank", "b.seed_id", "b.evidence_id")


def candidate_id(kind: str, knowledge_base: Column, document: Column, local: Column) -> Column:
    """{kind}_candidate_v1_ and the SHA-256 of the canonical JSON of what names a chunk or an evidence."""
    if kind not in ("chunk", "evidence"):
        raise ValueError("chunk or evidence")
    fields = {"schema_version": F.lit("1.0"), "kind": F.lit(kind), "knowledge_base_id": knowledge_base.cast("string"), "document_id": document.cast("string"), "local_id": local.cast("string")}
    named = F.when(F.length(F.trim(local.cast("string"))) > 0, F.sha2(T.canonical_json(fields), 256)).otherwise(F.raise_error(F.lit("a local id is blank")))
    return F.concat(F.lit(f"{kind}_candidate_v1_"), named)
