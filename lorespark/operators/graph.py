"""Property graphs as tables: supported entities, seeds, one and two hops, scores, and evidence for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.operators.similarity import similar_texts
from lorespark.operators.sparse import ranked

SEEDS, NEIGHBOURS, RELATIONS, EVIDENCE = 5, 20, 100, 50
# Bonus of each kind of path, and the scores of seed matches.
BONUS = {"seed": 0.08, "relation": 0.12, "bridge": 0.06, "mixed": 0.02}
EXACT, CONTAINS, LEXICAL = 1.0, 0.93, 0.78
WAYS, KINDS = ("exact", "contains", "lexical"), ("local_name", "local_alias", "canonical_name", "canonical_alias")


def supported(entities: DataFrame, support: DataFrame) -> DataFrame:
    """Entities that some evidence of their own document supports."""
    own = support.where("node_kind = 'entity'").select(F.col("node_id").alias("entity_id"), "document_id").distinct()
    return entities.join(own, ["entity_id", "document_id"], "left_semi")


def score(seed: Column, hop: Column, kind: Column) -> Column:
    """min(1, 0.72 * seed + 0.2 / (1 + hop) + bonus), to six places."""
    bonus = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BONUS.items()], F.lit(0.0))
    return F.round(F.least(F.lit(1.0), 0.72 * seed + 0.2 / (1 + hop) + bonus), 6)


def seeds(queries: DataFrame, terms: DataFrame, limit: int = SEEDS, generic: int | None = None, lexical: bool = True) -> DataFrame:
    """query_id, entity_id, method, score, term, canonical_id, rank: entities by their terms (entity_id, term and, if they have
    them, kind and canonical_id).

    exact: the query is the term (1.0); contains: it holds it, ASCII terms between word ends (0.93); lexical: their similarity is
    LEXICAL or more (0.88 of it). Methods rank in this order, within one by KINDS. A term that more than `generic` (4 * limit)
    entities share says nothing and is left out. Queries meet terms by the terms' first four characters, and, for similarity, by the
    similarity join's bounds.
    """
    generic = 4 * limit if generic is None else generic
    kind = F.col("kind") if "kind" in terms.columns else F.lit(KINDS[0])
    canonical = F.col("canonical_id").cast("string") if "canonical_id" in terms.columns else F.lit(None).cast("string")
    t = terms.select("entity_id", "term", T.label(F.col("term")).alias("norm"), kind.alias("kind"), canonical.alias("canonical_id")).distinct().where(F.length("norm") >= 2)
    shared = t.groupBy("norm").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") <= generic)
    t = t.join(shared.select("norm"), "norm")
    q, labels = queries.select("query_id", T.label(F.col("text")).alias("q")), t.select("norm").distinct()
    grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    at = q.select("query_id", "q", F.explode(F.array_distinct(F.concat(*[grams(F.col("q"), n) for n in (2, 3, 4)]))).alias("key"))
    held = at.join(labels.withColumn("key", F.substring("norm", 1, 4)), "key").where(T.contains_word(F.col("q"), F.col("norm")))
    exact = F.col("q") == F.col("norm")
    hit = held.select("query_id", "norm", F.when(exact, 0).otherwise(1).alias("way"), F.when(exact, EXACT).otherwise(CONTAINS).alias("score"))
    if lexical:
        words = labels.where(F.length("norm") >= 3)
        like = similar_texts(q.select(F.col("q").alias("s")), words.select(F.col("norm").alias("s")), LEXICAL).where(F.col("similarity") >= LEXICAL)
        like = q.join(like.select(F.col("x").alias("q"), F.col("y").alias("norm"), F.col("similarity").alias("r")), "q").where(~T.contains_word(F.col("q"), F.col("norm")))
        hit = hit.unionByName(like.select("query_id", "norm", F.lit(2).alias("way"), F.round(F.col("r") * 0.88, 6).alias("score")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    found = hit.join(t, "norm").withColumn("priority", F.col("way") * len(KINDS) + place)
    best = found.groupBy("query_id", "entity_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "priority", "norm", "term", F.coalesce("canonical_id", F.lit("")).alias("c"), "kind", "way")).alias("b"))
    ways = F.array(*map(F.lit, WAYS))
    best = best.select("query_id", "entity_id", F.concat_ws("_", F.get(ways, F.col("b.way")), "b.kind").alias("method"), (-F.col("b.s")).alias("score"), F.col("b.term").alias("term"), F.nullif(F.col("b.c"), F.lit("")).alias("canonical_id"), F.col("b.priority").alias("priority"))
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("priority"), F.asc("entity_id")], limit).drop("priority")


def edges(relations: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """a, b, relation_id, direction: forward and reverse relations, and bridges between members of one canonical entity."""
    fw = relations.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), "relation_id", F.lit("forward").alias("direction"))
    bw = relations.select(F.col("target_entity_id").alias("a"), F.col("source_entity_id").alias("b"), "relation_id", F.lit("reverse").alias("direction"))
    out = fw.unionByName(bw)
    if memberships is not None:
        m = memberships.select(F.col("local_entity_id").alias("a"), "canonical_entity_id")
        o = memberships.select(F.col("local_entity_id").alias("b"), "canonical_entity_id")
        out = out.unionByName(m.join(o, "canonical_entity_id").where("a <> b").select("a", "b", F.col("canonical_entity_id").alias("relation_id"), F.lit("bridge").alias("direction")))
    return out


def expand(paths: DataFrame, edge: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Paths (query_id, seed_id, seed_score, nodes, relations, kinds) one hop longer, no node twice.

    At most `neighbours` of a node are followed, those of the least id; of a neighbour first one edge each, then the next.
    """
    own = paths.withColumn("a", F.element_at("nodes", -1)).join(edge, "a").where(~F.array_contains("nodes", F.col("b")))
    by = ["query_id", "seed_id", "nodes"]
    near = Window.partitionBy(*by).orderBy("b")
    own = own.withColumn("nth", F.dense_rank().over(near)).where(F.col("nth") <= neighbours)
    own = own.withColumn("offset", F.row_number().over(Window.partitionBy(*by, "b").orderBy("relation_id", "direction")))
    kind = F.when(F.col("direction") == "bridge", "bridge").otherwise("relation")
    return own.select("query_id", "seed_id", "seed_score", F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("relations", F.col("relation_id")).alias("relations"), F.array_append("kinds", kind).alias("kinds"), "offset", "nth")


def traverse(found: DataFrame, edge: DataFrame, hops: int = 2, relations: int = RELATIONS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Paths of 0 to `hops` hops from the seeds; of each query at most `relations` a hop, fair to neighbours."""
    if not 1 <= hops <= 2:
        raise ValueError("one or two hops")
    text = F.array().cast("array<string>")
    start = found.select("query_id", F.col("entity_id").alias("seed_id"), F.col("score").alias("seed_score"), F.array("entity_id").alias("nodes"), text.alias("relations"), text.alias("kinds"))
    out, now = start.withColumn("hop", F.lit(0)), start
    for hop in range(1, hops + 1):
        more = expand(now, edge, neighbours)
        more = ranked(more, ["query_id"], [F.asc("offset"), F.asc("nth"), F.asc("seed_id"), F.asc("nodes"), F.asc("relations")], relations)
        now = more.select(*start.columns)
        out = out.unionByName(now.withColumn("hop", F.lit(hop)))
    kinds = F.array_distinct("kinds")
    kind = F.when(F.col("hop") == 0, "seed").when(F.size(kinds) > 1, "mixed").otherwise(F.element_at(kinds, 1))
    return out.withColumn("kind", kind).withColumn("score", score(F.col("seed_score"), F.col("hop"), F.col("kind")))


PLACES = ("page_start", "page_end", "chunk_id")


def evidence_of(paths: DataFrame, support: DataFrame, limit: int = EVIDENCE, documents: list[str] | None = None) -> DataFrame:
    """query_id, evidence_id, document_id (and PLACES, as far as the support has them), score, hop, min_hop, seed_id, n_paths, paths, rank.

    A path brings the evidence of all its entities and of all its relations. The best path of an evidence is that of the highest score, fewer hops,
    greater seed; hop is its length, min_hop the least of any. All distinct paths are kept, as `nodes/relations`, sorted. Order: score, min_hop, document,
    places, evidence. The filter by documents follows the scoring and precedes the cut.
    """
    own = paths.select("query_id", "seed_id", "score", "hop", F.concat_ws("/", F.array_join("nodes", ">"), F.array_join("relations", ">")).alias("path"), "nodes", "relations")
    parts = lambda kind, c: own.select("query_id", "seed_id", "score", "hop", "path", F.lit(kind).alias("node_kind"), F.explode(c).alias("node_id"))
    places = [c for c in PLACES if c in support.columns]
    known = support.select("node_kind", "node_id", "evidence_id", "document_id", *places).distinct()
    reached = parts("entity", "nodes").unionByName(parts("relation", "relations")).join(known, ["node_kind", "node_id"])
    best = F.max(F.struct("score", (-F.col("hop")).alias("nearer"), "seed_id"))
    of = ["query_id", "evidence_id", "document_id", *places]
    got = reached.groupBy(*of).agg(best.alias("b"), F.min("hop").alias("min_hop"), F.sort_array(F.collect_set("path")).alias("paths"))
    got = got.select(*of, F.col("b.score").alias("score"), (-F.col("b.nearer")).alias("hop"), "min_hop", F.col("b.seed_id").alias("seed_id"), F.size("paths").cast("long").alias("n_paths"), "paths")
    got = got.where(F.col("document_id").isin(documents)) if documents is not None else got
    return ranked(got, ["query_id"], [F.desc("score"), F.asc("min_hop"), F.asc("document_id"), *[F.asc(c) for c in places], F.asc("evidence_id")], limit)


def covered(support: DataFrame) -> DataFrame:
    """part, id: the documents with evidence, the chunks of any evidence, and those whose evidence supports an entity or a relation; once each."""
    kind = F.array(F.struct(F.lit("documents").alias("part"), F.col("document_id").cast("string").alias("id")), F.struct(F.lit("evidence_chunks").alias("part"), F.col("chunk_id").cast("string").alias("id")), F.struct(F.concat("node_kind", F.lit("_chunks")).alias("part"), F.col("chunk_id").cast("string").alias("id")))
    return support.select(F.inline(kind)).where("id is not null").distinct()


def coverage_snapshot(entities: DataFrame, relations: DataFrame, support: DataFrame, memberships: DataFrame) -> DataFrame:
    """part, n, ids: what there is of each part of the graph; for the parts of `covered` also a fingerprint of their ids, so that two snapshots can be compared
    without keeping the sets."""
    ids = F.sum(F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long"))
    sets = covered(support).groupBy("part").agg(F.count("*").alias("n"), ids.alias("ids"))
    counts = {"entities": (entities, "entity_id"), "relations": (relations, "relation_id"), "evidence": (support, "evidence_id"), "canonical_entities": (memberships, "canonical_entity_id"), "memberships": (memberships, None)}
    for part, (df, key) in counts.items():
        n = F.countDistinct(key) if key else F.count("*")
        sets = sets.unionByName(df.agg(n.alias("n")).select(F.lit(part).alias("part"), "n"), allowMissingColumns=True)
    return sets


def merged(entities: DataFrame, keys: list[str], aliases: str = "aliases") -> DataFrame:
    """One row for each entity: aliases united, distinct and sorted."""
    return entities.select(*keys, F.explode_outer(aliases).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_set("x")).alias(aliases))


def identity_conflicts(entities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, n of ids whose other columns differ."""
    return entities.groupBy(key).agg(F.countDistinct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).alias("n")).where("n > 1")


def without_document(entities: DataFrame, relations: DataFrame, support: DataFrame, document_id: str, links: DataFrame | None = None, memberships: DataFrame | None = None, canonicals: DataFrame | None = None) -> dict[str, DataFrame]:
    """What stays once a document's evidence goes: support, relations and entities that some evidence still supports; then links (a, b) between entities that stay,
    memberships (local_entity_id, canonical_entity_id) of such entities, and canonical entities (canonical_entity_id) that have a member left."""
    left = support.where(F.col("document_id") != document_id)
    of = lambda kind, key: left.where(F.col("node_kind") == kind).select(F.col("node_id").alias(key)).distinct()
    keep = entities.join(of("entity", "entity_id"), "entity_id", "left_semi")
    ids = keep.select("entity_id").distinct()
    among = lambda df, *ends: [df := df.join(ids.withColumnRenamed("entity_id", c), c, "left_semi") for c in ends][-1]  # noqa: E731, F841
    rel = among(relations.join(of("relation", "relation_id"), "relation_id", "left_semi"), "source_entity_id", "target_entity_id")
    out = {"support": left, "relations": rel.select(*relations.columns), "entities": keep}
    if links is not None:
        out["links"] = among(links, "a", "b").select(*links.columns)
    if memberships is not None:
        out["memberships"] = among(memberships, "local_entity_id").select(*memberships.columns)
        if canonicals is not None:
            out["canonicals"] = canonicals.join(out["memberships"].select("canonical_entity_id").distinct(), "canonical_entity_id", "left_semi")
    return out
