"""Audits: leakage, coverage, order, duplicates, attribution, drift, resumption, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as T


def _compared_text(texts: DataFrame, key: str, text: str, ids: DataFrame, least: int) -> DataFrame:
    """key, t (the text as it is compared), g (its 3-grams, of texts of `least` characters or more): once a text, only of those asked for."""
    plain = T.squeezed(T.unescaped(F.col(text)))
    of = texts.join(ids.select(key).distinct(), key, "left_semi").select(key, plain.alias("t"))
    return of.withColumn("g", F.when(F.length("t") >= least, T.character_ngrams(F.col("t"))))


def leakage(pairs: DataFrame, queries: DataFrame, sources: DataFrame, query_key: str = "query_id", source_key: str = "doc_id", metadata: list[str] | None = None, copy_chars: int = 24, near_chars: int = 32, near: float = 0.8) -> DataFrame:
    """pairs (of the keys) with codes, sorted: exact_copy; metadata_in_query (a metadata value of the source stands in the query); near_copy (3-grams, Jaccard
    similarity, of texts of near_chars or more); substring (one text stands in the other, the source's having copy_chars or more).

    queries: query_key, query; sources: source_key, source and the metadata columns. Texts are compared without white space, case and entities. Sets of
    n-grams are made once a text; a pair compares them only if their sizes allow the similarity. Blank sources leak nothing.
    """
    q = _compared_text(queries, query_key, "query", pairs, near_chars).withColumnsRenamed({"t": "q", "g": "gq"})
    s = _compared_text(sources, source_key, "source", pairs, near_chars).withColumnsRenamed({"t": "s", "g": "gs"})
    both = pairs.join(q, query_key).join(s, source_key)
    if metadata:
        values = F.array(*[T.squeezed(F.col(c).cast("string")) for c in metadata])
        both = both.join(sources.select(source_key, values.alias("m")), source_key)
    there = F.length("s") > 0
    sized = F.least(F.size("gq"), F.size("gs")) >= near * F.greatest(F.size("gq"), F.size("gs"))
    alike = F.when(F.col("gq").isNotNull() & F.col("gs").isNotNull(), F.when(sized, T.jaccard(F.col("gq"), F.col("gs")) >= near))
    codes = [
        F.when(there & (F.col("q") == F.col("s")), "exact_copy"),
        F.when(F.exists("m", lambda v: (F.length(v) > 0) & F.contains(F.col("q"), v)), "metadata_in_query") if metadata else F.lit(None).cast("string"),
        F.when(there & alike, "near_copy"),
        F.when((F.length("s") >= copy_chars) & (F.contains("s", "q") | F.contains("q", "s")), "substring"),
    ]
    return both.withColumn("codes", F.filter(F.array(*codes), lambda c: c.isNotNull())).drop("q", "s", "gq", "gs", "m")


def near_pairs(items: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """a, b, similarity of items whose 3-grams have at least this Jaccard similarity.

    Prefix filter: in the order of rarest n-grams first, two sets that are so similar share one of the first
    n - ceil(threshold * n) + 1; only these are joined, then whole sets compared. No pair is lost.
    """
    grams = items.select(F.col(key).alias("id"), F.explode(T.character_ngrams(T.squeezed(F.col(text)))).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    sets = grams.join(df, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))
    n = F.size("s")
    sets = sets.select("id", F.transform("s", lambda x: x["g"]).alias("s"), n.alias("n"))
    head = sets.select("id", "n", F.explode(F.slice("s", F.lit(1), (n - F.ceil(F.lit(threshold) * n) + 1).cast("int"))).alias("g"))
    x, y = head.select(F.col("id").alias("a"), F.col("n").alias("na"), "g"), head.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    pairs = x.join(y, "g").where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", F.round(T.jaccard(F.col("sa"), F.col("sb")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicate_groups(df: DataFrame, by: Column, key: str) -> DataFrame:
    """fingerprint, n, first key of contents that occur more than once."""
    return df.groupBy(by.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def order_faults(df: DataFrame, by: list[str], sequence: str, places: list[str]) -> DataFrame:
    """code, n: not_monotone (a place at or before the one before it in the sequence), repeated."""
    w = Window.partitionBy(*by).orderBy(sequence)
    now, before = F.struct(*places), F.lag(F.struct(*places)).over(w)
    code = F.when(now == before, "repeated").when(now < before, "not_monotone")
    return df.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def missing(df: DataFrame, known: DataFrame, on: list[str], code: str) -> DataFrame:
    """code, n of rows without their counterpart."""
    return df.join(known.select(*on).distinct(), on, "left_anti").select(F.lit(code).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """One row: matched, missing, stale, changed of two keyed tables."""
    both = expected.select(*keys, F.col(fingerprint).alias("e"), F.lit(1).alias("he")).join(actual.select(*keys, F.col(fingerprint).alias("a"), F.lit(1).alias("ha")), keys, "full_outer")
    he, ha = F.col("he").isNotNull(), F.col("ha").isNotNull()
    return both.agg(F.count_if(he & ha & F.col("e").eqNullSafe(F.col("a"))).alias("matched"), F.count_if(he & ~ha).alias("missing"), F.count_if(~he & ha).alias("stale"), F.count_if(he & ha & ~F.col("e").eqNullSafe(F.col("a"))).alias("changed"))


def table_fingerprint(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    """One row: number of rows and a fingerprint that depends on neither their order nor their partitions.

    Rows are hashed on their own and the hashes are added up, so nothing is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", part(0).cast("string"), part(1).cast("string")), 256).alias(name))


def attribution(points: DataFrame, owners: DataFrame, doc: str = "document_id", kb: str = "kb_id") -> DataFrame:
    """points with state of their document's owner (unmapped, ambiguous, mapped) and action (ok, update, conflict, none)."""
    own = owners.groupBy(doc).agg(F.countDistinct(kb).alias("n_kb"), F.min(kb).alias("owner"))
    both = points.join(own, doc, "left")
    state = F.when(F.col("n_kb").isNull(), "unmapped").when(F.col("n_kb") == 0, "null").when(F.col("n_kb") > 1, "ambiguous").otherwise("mapped")
    action = F.when(state != "mapped", "none").when(F.col(kb).isNull(), "update").when(F.col(kb) == F.col("owner"), "ok").otherwise("conflict")
    return both.withColumns({"state": state, "action": action})


def registration_plan(incoming: DataFrame, registered: DataFrame, key: str, content: str) -> DataFrame:
    """incoming with plan: insert, valid (the same is there) or conflict; to be applied only if there is no conflict."""
    both = incoming.join(registered.select(key, F.col(content).alias("there")), key, "left")
    return both.withColumn("plan", F.when(F.col("there").isNull(), "insert").when(F.col("there") == F.col(content), "valid").otherwise("conflict")).drop("there")


def resume_decisions(inputs: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, decision: reuse if the document's checkpoint and all its chunks' match and are completed; rebuild if a checkpoint
    differs; new if there is none."""
    done = chunks.groupBy("document_id").agg(F.bool_and((F.col("status") == "completed") & (F.col("fingerprint") == F.col("expected"))).alias("all_done"))
    both = inputs.join(documents.select("document_id", F.col("fingerprint").alias("seen"), "status"), "document_id", "left").join(done, "document_id", "left")
    same = (F.col("seen") == F.col("fingerprint")) & (F.col("status") == "completed") & F.coalesce("all_done", F.lit(False))
    return both.select("document_id", F.when(F.col("seen").isNull(), "new").when(same, "reuse").otherwise("rebuild").alias("decision"))


def rolled_up(chunks: DataFrame) -> DataFrame:
    """document_id, completed, failed, deferred, status (completed, provider_blocked, failed)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    df = chunks.groupBy("document_id").agg(n("completed"), n("failed"), n("deferred"), F.count("*").alias("n"))
    return df.select("document_id", "completed", "failed", "deferred", F.when(F.col("completed") == F.col("n"), "completed").when(F.col("deferred") > 0, "provider_blocked").otherwise("failed").alias("status"))


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.col(seq)).alias("r")).select(key, "r.*")


def representatives(df: DataFrame, content: list[str], order: list[str]) -> DataFrame:
    """One row of equal contents, the first in order."""
    w = Window.partitionBy(*content).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def contiguous(df: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """by, n, ok: whether the ordinals of a group are 0 to n - 1, once each."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), ((F.max(ordinal) + 1 == F.count("*")) & (F.countDistinct(ordinal) == F.count("*")) & (F.min(ordinal) == 0)).alias("ok"))


def stratified(df: DataFrame, by: str, order: list[str], n: int, offset: int = 0) -> DataFrame:
    """Of each stratum the rows offset + 1 to offset + n in order."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rn", rn).where((F.col("rn") > offset) & (F.col("rn") <= offset + n)).drop("rn")


def diverse(df: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """n rows: first the best of each kind, then the best of the rest."""
    tier = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn("tier", F.when(tier == 1, 0).otherwise(1)).orderBy("tier", *order).limit(n)


def quotas(groups: list[tuple[str, int]], wanted: int) -> list[str]:
    """Names of groups whose sizes add up to `wanted`, none split; the first such choice in order of names (backtracking with memory).

    For a few hundred groups on the driver.
    """
    items = sorted(groups)
    dead: set[tuple[int, int]] = set()

    def pick(i: int, left: int) -> list[str] | None:
        if left == 0:
            return []
        if i == len(items) or left < 0 or (i, left) in dead:
            return None
        for take in (True, False):
            rest = pick(i + 1, left - items[i][1] * take)
            if rest is not None:
                return [items[i][0]] * take + rest
        dead.add((i, left))
        return None

    if (found := pick(0, wanted)) is None:
        raise ValueError("no groups add up to this quota")
    return found
