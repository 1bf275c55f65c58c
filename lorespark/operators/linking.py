"""Entity linking: blocking, pair signals, decisions, components and canonical entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.functions.scratch import cut
from lorespark.operators.similarity import long_enough, ratio

BLOCK, WINDOW, BUDGET, SIMILAR = 64, 16, 200, 0.72


def blocks(entities: DataFrame) -> DataFrame:
    """entity_id, kind (exact, prefix), term: the keys under which entities (entity_id, name, aliases, type) meet: every name and alias, and the
    first two characters of the name."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.label))
    terms = entities.select("entity_id", F.explode(names).alias("term")).where("term <> ''")
    heads = entities.select("entity_id", F.lit("prefix").alias("kind"), F.substring(T.label(F.col("name")), 1, 2).alias("term")).where("length(term) = 2")
    return terms.select("entity_id", F.lit("exact").alias("kind"), "term").unionByName(heads).distinct()


def telemetry(entities: DataFrame, most: int = BLOCK) -> DataFrame:
    """kind, n_blocks, skipped_blocks, skipped_pairs: what blocks of more than `most` members leave out."""
    size = blocks(entities).groupBy("kind", "term").agg(F.count("*").alias("n"))
    big = F.col("n") > most
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return size.groupBy("kind").agg(F.count("*").alias("n_blocks"), F.count_if(big).alias("skipped_blocks"), F.coalesce(F.sum(F.when(big, pairs)), F.lit(0.0)).cast("long").alias("skipped_pairs"))


def candidates(entities: DataFrame, most: int = BLOCK, window: int = WINDOW, prefix: bool = True, similar: float | None = SIMILAR) -> DataFrame:
    """a, b, kind, term: pairs a < b that share a block of at most `most`; in prefix blocks only the next `window` by id, and of these only
    those whose names are similar enough."""
    keys = blocks(entities) if prefix else blocks(entities).where("kind = 'exact'")
    w = Window.partitionBy("kind", "term")
    sized = keys.groupBy("kind", "term").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    members = keys.join(sized, ["kind", "term"]).withColumn("rn", F.row_number().over(w.orderBy("entity_id")))
    x = members.select("kind", "term", F.col("entity_id").alias("a"), F.col("rn").alias("ra"))
    y = members.select("kind", "term", F.col("entity_id").alias("b"), F.col("rn").alias("rb"))
    pairs = x.join(y, ["kind", "term"]).where("rb > ra").where((F.col("kind") == "exact") | (F.col("rb") <= F.col("ra") + window)).select("a", "b", "kind", "term")
    if similar is None or not prefix:
        return pairs
    near = with_similarity(pairs.where("kind = 'prefix'"), entities, similar).where(F.col("similarity") >= similar)
    return pairs.where("kind = 'exact'").unionByName(near.select("a", "b", "kind", "term"))


def with_similarity(pairs: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """pairs (a, b) with similarity: the matching-blocks ratio of their names; each pair of names is matched once, and only if their lengths
    allow `least`, else the similarity is 0."""
    named = entities.select("entity_id", T.label(F.col("name")).alias("n"))
    both = pairs.join(named.withColumnsRenamed({"entity_id": "a", "n": "name_a"}), "a").join(named.withColumnsRenamed({"entity_id": "b", "n": "name_b"}), "b")
    names = both.where(long_enough(F.length("name_a"), F.length("name_b"), least)).select("name_a", "name_b").distinct()
    matched = names.withColumn("similarity", F.round(ratio(F.col("name_a"), F.col("name_b")), 6))
    return both.join(matched, ["name_a", "name_b"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def budgeted(pairs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first `budget` distinct pairs by (block, a, b), each at its first block."""
    first = pairs.groupBy("a", "b").agg(F.min(F.struct("kind", "term")).alias("block"))
    return first.orderBy("block", "a", "b").limit(budget).select("a", "b", "block.kind", "block.term")


def signals(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """pairs with name_match, term_overlap, alias_overlap, same_type, same_document and similarity."""
    e = entities.select("entity_id", T.label(F.col("name")).alias("n"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.label).alias("al"), "type", "document_id")
    x = e.select(*[F.col(c).alias(f"{c}_a") for c in e.columns]).withColumnRenamed("entity_id_a", "a")
    y = e.select(*[F.col(c).alias(f"{c}_b") for c in e.columns]).withColumnRenamed("entity_id_b", "b")
    both = with_similarity(pairs.select("a", "b"), entities).drop("name_a", "name_b").join(x, "a").join(y, "b")
    terms = lambda s: F.array_distinct(F.concat(F.array(f"n_{s}"), f"al_{s}"))
    return both.select("a", "b", (F.col("n_a") == F.col("n_b")).alias("name_match"), F.array_sort(F.array_intersect(terms("a"), terms("b"))).alias("term_overlap"), F.array_sort(F.array_intersect("al_a", "al_b")).alias("alias_overlap"), (F.col("type_a") == F.col("type_b")).alias("same_type"), (F.col("document_id_a") == F.col("document_id_b")).alias("same_document"), F.col("n_a").alias("name_a"), F.col("n_b").alias("name_b"), "similarity")


def decisions(df: DataFrame, similarity: str = "similarity") -> DataFrame:
    """signals (with a similarity) with decision, reason, confidence. Nothing is linked without adjudication."""
    none = F.size("term_overlap") == 0
    s = F.col(similarity)
    decision = F.when(~F.col("same_type"), "NO_LINK").when(none & (s < SIMILAR), "NO_LINK").otherwise("UNCERTAIN")
    reason = F.when(~F.col("same_type"), "type_mismatch").when(none & (s < SIMILAR), "no_shared_signal").otherwise("needs_adjudication")
    confidence = F.when(decision == "NO_LINK", F.lit(1.0)).when(s >= 0.5, s)
    return df.withColumns({"decision": decision, "reason": reason, "confidence": confidence})


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, root: the least node reachable over links, for nodes with links. Labels spread to neighbours and jump to labels' labels;
    each round is cut off as a checkpoint in the shared folder."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        new = labels.join(near, "x").select("x", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = new.select(F.col("x").alias("l"), F.col("l").alias("l2"))
        new = new.join(jump, "l", "left").select("x", F.coalesce(F.least("l", "l2"), "l").alias("l"), "old")
        new = cut(new)
        labels = new.select("x", "l")
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("l").alias("root"))
    raise RuntimeError("components have not settled")


def maintained(members: DataFrame, links: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root of every node with links; the links) after links (a, b) have gone and come; members: node, root as they were for links.

    Only components that a changed link touches are computed anew, from their own links; all others keep their rows. Links count in either direction,
    and nodes that have lost their last link are members no more.
    """
    one = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(one(links).join(one(removed), ["a", "b"], "left_anti").unionByName(one(added)).distinct())
    ends = one(removed).unionByName(one(added))
    changed = cut(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    roots = members.join(changed, "node", "left_semi").select("root").distinct()
    touched = cut(members.join(roots, "root", "left_semi").select("node").unionByName(changed).distinct())
    own = now.join(touched.withColumnRenamed("node", "a"), "a", "left_semi")  # a component's links lie within it
    rest = members.join(touched, "node", "left_anti").select("node", "root")
    return rest if own.isEmpty() else rest.unionByName(components(own)), now


def canonical_plan(members: DataFrame, entities: DataFrame) -> DataFrame:
    """root, representative (least normalised name, id), n_members, aliases (all names and aliases, distinct and sorted)."""
    e = entities.select(F.col("entity_id").alias("node"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    both = members.join(e, "node")
    names = both.select("root", F.explode(F.concat(F.array("name"), "aliases")).alias("alias")).groupBy("root").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    main = both.groupBy("root").agg(F.min(F.struct(T.label(F.col("name")).alias("n"), F.col("node").alias("id"))).alias("r"), F.count("*").alias("n_members"))
    return main.join(names, "root").select("root", F.col("r.id").alias("representative"), "n_members", "aliases")


def current_decisions(log: DataFrame) -> DataFrame:
    """The latest decision of each pair: by time, then id."""
    w = Window.partitionBy("link_pair_id").orderBy(F.desc("created_at"), F.asc("decision_id"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def grounded(extractions: DataFrame, name: str, aliases: str, text: str) -> DataFrame:
    """extractions with reason: null if the name or an alias, and all aliases, occur in the text."""
    t = T.label(F.col(text))
    has = lambda c: F.contains(t, T.label(c))
    none = F.coalesce(aliases, F.array().cast("array<string>"))
    named = has(F.col(name)) | F.exists(none, has)
    reason = F.when(~named, "not_mentioned").when(~F.forall(none, has), "alias_not_mentioned")
    return extractions.withColumn("reason", reason)
