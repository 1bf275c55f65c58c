"""Evaluation analytics, audits and the usage ledger over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.scratch import cut
from lorespark.operators import audits as A
from lorespark.operators import metrics as M
from lorespark.operators import selection, sparse
from lorespark.operators import similarity as S
from lorespark.plans.retrieval import bm25_sql, document_index
from lorespark.sources import ordered
from lorespark.sources.tables import table as _t


def _events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").withColumn("k", k)


def agg_15_nearest_rank(spark, sf_dir):
    return selection.nearest_ranks(_t(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, few=500)


def agg_15_nearest_rank_list(spark, sf_dir):
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(M.nearest_rank(F.col("n_nationkey"), 0.5).alias("p50"))


def agg_16_percentiles(spark, sf_dir):
    found = selection.percentiles(_t(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, few=500)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95")])


def agg_17_summary(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.when(F.col("k") % 5 != 0, F.col("value")))
    return e.groupBy("event_type").agg(*M.summary("v"))


def agg_18_rates(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(M.rate(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click")).alias("purchase_rate"))


def agg_19_stage_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    kinds = ["view", "signup", "error", "click", "purchase"]
    return e.groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count_if((F.col("event_type") == "error") & (F.col("k") > 50)).alias("late_errors"), F.countDistinct("user_id").alias("users"))


def agg_20_strict_sum(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.when((F.col("user_id") % 7 != 0) | (F.col("k") > 3), F.col("k")))
    return e.groupBy("user_id").agg(M.strict_sum("v").alias("total"))


def agg_21_cost(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = F.when(F.col("k") % 9 != 0, F.col("k") * 2)
    return e.select("event_id", F.round(M.cost(F.col("k"), 0.25, out, 1.5), 6).alias("cost"))


def agg_22_failed_buckets(spark, sf_dir):
    e = M.tumbling(_t(spark, sf_dir, "events").where("event_type = 'error'"), "ts", 5)
    return e.groupBy("bucket").agg(F.count("*").alias("attempts"), F.countDistinct("user_id").alias("users")).where("attempts > 1")


def agg_23_extrapolation(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.where("event_id % 10 = 0").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum("value").alias("v")).first()
    total = e.count()
    return e.sparkSession.createDataFrame([(total, round(total * s["k"] / s["n"], 4), round(total * s["v"] / s["n"], 2))], "target long, tokens double, value double")


def agg_26_subject_summary(spark, sf_dir):
    docs = A.representatives(_t(spark, sf_dir, "documents").withColumn("sha", F.md5("text")), ["sha"], ["doc_id"])
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.percentile("n_chars", 0.5), 4).alias("p50"), F.round(M.rate(F.count_if(F.col("n_chars") > 1000), F.count("*")), 6).alias("long_rate"))


def agg_27_duplicates(spark, sf_dir):
    return A.duplicate_groups(_t(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


def agg_27_inventory(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("files"), F.countDistinct(F.md5("text")).alias("contents"), F.sum(F.octet_length("text")).alias("bytes"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


def agg_31_warnings(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", F.when(F.col("value") > 20, "slow_error").otherwise("error")).when(F.col("value") > 50, "slow")
    counts = _t(spark, sf_dir, "events").select(F.col("user_id"), kind.alias("w")).where("w is not null").groupBy("user_id", "w").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n"))))).alias("warnings"))


def agg_30_bad_cases(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    cats = F.filter(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("n_chars") > 8000, "long"), F.when(F.contains("text", F.lit("!!")), "shouting"), F.when(F.contains("text", F.lit(" | ")), "table")), lambda c: c.isNotNull())
    return d.select(F.explode(cats).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def top_06_worst(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.contains("text", F.lit("!!")).cast("int").alias("shouting"), "n_chars").orderBy(F.desc("shouting"), F.desc("n_chars"), "doc_id").limit(10)


def top_04_stratified(spark, sf_dir):
    return A.stratified(_t(spark, sf_dir, "documents"), "source", ["doc_id"], 3, 2).select("source", "doc_id")


def top_05_diverse(spark, sf_dir):
    return A.diverse(_t(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.asc("doc_id")], 30).select("doc_id", "source", "tier")


def leak_01_codes(spark, sf_dir):
    """Benchmark items against the documents that answer them best; items of an even length have a document's number in their text."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    run = cut(sparse.search(items, document_index(spark, sf_dir), "doc_id", "item_id", limit=3, matched=False).select("query_id", "doc_id"))
    docs = docs.join(F.broadcast(run.select("doc_id").distinct()), "doc_id", "left_semi")
    first = run.groupBy("query_id").agg(F.min("doc_id").alias("first"))
    queries = items.select(F.col("item_id").alias("query_id"), "text").join(first, "query_id")
    key = lambda c: F.concat(F.lit("doc-"), c.cast("string"), F.lit("-end"))
    named = F.when(F.length("text") % 2 == 0, F.concat("text", F.lit(" "), key(F.col("first")))).otherwise(F.col("text"))
    sources = docs.select("doc_id", F.col("text").alias("source"), key(F.col("doc_id")).alias("name"))
    got = A.leakage(run, queries.select("query_id", named.alias("query")), sources, metadata=["name"])
    return got.select("query_id", "doc_id", F.array_join("codes", ",").alias("codes")).where("codes <> ''")


def jn_15_near_pairs(spark, sf_dir):
    """Benchmark items, those of an even length also without their last three characters."""
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text")
    cut = b.where("length(text) % 2 = 0").select(F.concat(F.lit("cut-"), "doc_id").alias("doc_id"), F.expr("left(text, length(text) - 3)").alias("text"))
    return A.near_pairs(b.unionByName(cut), "doc_id", "text", 0.8)


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), T.label(F.col("text")).alias("text"))


def jn_15_ratio_pairs(spark, sf_dir):
    """Turns of conversations, of which the short ones come once more with one character changed, that are alike by matching blocks; of copies, those of one rank."""
    t = _turns(spark, sf_dir)
    changed = t.where(F.length("text").between(30, 199)).select((F.col("turn_id") + 500_000_000).alias("turn_id"), F.expr("overlay(text placing '#' from 5 for 1)").alias("text"))
    return S.similar_pairs(t.unionByName(changed), "turn_id", "text", 0.92, ranked=True)


def leak_02_same_text(spark, sf_dir):
    """Turns, every tenth of them also with other white space."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "text")
    spaced = c.where("conv_id % 10 = 0").select((F.col("conv_id") + 1_000_000).alias("conv_id"), F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit(" \t"))).alias("text"))
    return A.duplicate_groups(c.unionByName(spaced), F.md5(T.squeezed(F.col("text"))), "conv_id")


def aud_01_labels(spark, sf_dir):
    lab, docs = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents")
    unlabelled = A.missing(docs, lab, ["doc_id"], "unlabelled")
    return A.missing(lab, docs.where("n_chars > 50"), ["doc_id"], "label_without_text").unionByName(unlabelled)


def aud_03_order(spark, sf_dir):
    return A.order_faults(_t(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


def jn_12_index_audit(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("f"))
    stored = d.where("doc_id % 11 <> 0").withColumn("f", F.when(F.col("doc_id") % 13 == 0, F.lit("old")).otherwise(F.col("f"))).union(d.where("doc_id % 50 = 0").selectExpr("doc_id + 1000000", "f"))
    return A.compared(d, stored, ["doc_id"], "f")


def ret_05_index_status(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("f"))
    stored = d.where("doc_id % 11 <> 0").withColumn("f", F.when(F.col("doc_id") % 13 == 0, F.lit("old")).otherwise(F.col("f")))
    return sparse.index_status(d, stored, ["doc_id"], "f")


def aud_04_fingerprint(spark, sf_dir):
    return A.table_fingerprint(_t(spark, sf_dir, "nation"))


def snk_14_attribution(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    points = d.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("kb_id"))
    owners = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("kb_id")).union(d.where("doc_id % 25 = 1").selectExpr("doc_id", "'zz'"))
    return A.attribution(points, owners).groupBy("state", "action").agg(F.count("*").alias("n"))


def snk_13_registration(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"))
    there = d.where("doc_id % 3 = 0").withColumn("sha", F.when(F.col("doc_id") % 30 == 0, F.lit("other")).otherwise(F.col("sha")))
    return A.registration_plan(d, there, "doc_id", "sha").groupBy("plan").agg(F.count("*").alias("n"))


def snk_15_resume(spark, sf_dir):
    inputs = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.count("*").cast("string").alias("fingerprint"))
    documents = inputs.where("document_id % 5 <> 0").withColumn("fingerprint", F.when(F.col("document_id") % 7 == 0, F.lit("old")).otherwise(F.col("fingerprint"))).withColumn("status", F.lit("completed"))
    chunks = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.lit("f").alias("fingerprint"), F.lit("f").alias("expected"), F.when(F.col("o_totalprice") > 499000, "failed").otherwise("completed").alias("status"))
    return A.resume_decisions(inputs, documents, chunks)


def snk_16_roll_up(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_totalprice") > 450000, "failed").when(F.col("o_totalprice") < 5000, "deferred").otherwise("completed")
    chunks = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), status.alias("status"))
    return A.rolled_up(chunks)


def snk_12_latest(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return A.latest(log, "user_id", "event_id").select("user_id", "event_id", "event_type")


def src_03_representatives(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "source", F.md5("text").alias("sha"))
    return A.representatives(d, ["sha"], ["source", "doc_id"]).select("doc_id", "source")


def src_05_runs(spark, sf_dir):
    """Runs of neighbouring turns of one role, in the order of the table's files, and the conversations as runs: which come back."""
    rows = ordered.in_file_order(spark, f"{sf_dir}/conversations.parquet")
    keyed = rows.withColumn("key", F.when(F.col("conv_id") % 7 == 0, F.lit("seventh")).otherwise(F.col("conv_id").cast("string")))
    found = ordered.runs(keyed, "key", block=100)
    return found.groupBy("key").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.max("n").alias("longest"))


def src_05_contiguous(spark, sf_dir):
    return A.contiguous(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn")


def src_04_duplicate_keys(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


def flt_06_exclusion(spark, sf_dir):
    """Chunks that share a long token with the query's gold text, but none with another set of texts."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).where("length(term) > 12")
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    good, bad = items.where("item_id % 2 = 0").select("term").distinct(), items.where("item_id % 2 = 1").select("term").distinct()
    return docs.join(good, "term", "left_semi").select("doc_id").distinct().join(docs.join(bad, "term", "left_semi").select("doc_id").distinct(), "doc_id", "left_anti")


def cmp_01_tolerance(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    near = F.col("o_totalprice") * (1 + F.when(F.col("o_orderkey") % 2 == 0, 1e-10).otherwise(1e-8))
    return o.groupBy(M.nearly_equal(F.col("o_totalprice"), near).alias("equal")).agg(F.count("*").alias("n"))


def cmp_03_outcomes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", F.when(F.col("value") > 20, "execution_failure").otherwise("validation_failure")).when(F.col("event_type") == "purchase", F.when(F.col("value") > 30, "success").otherwise("result_mismatch")).otherwise("not_applicable")
    return e.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def agg_10_split_summary(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("split", F.when(F.col("event_id") % 3 == 0, "test").otherwise("dev"))
    a = e.groupBy("split").agg(F.round(F.avg("value"), 6).alias("base"), F.round(F.avg(F.when(F.col("k") > 10, F.col("value"))), 6).alias("system"))
    return a.select("split", "base", "system", F.round(F.col("system") - F.col("base"), 6).alias("delta"), M.rate(F.col("system") - F.col("base"), F.col("base")).alias("relative"))


def srt_02_pagination(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)


def smp_01_review(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("n_chars > 20")
    first = A.representatives(d, ["lang"], ["source", "doc_id"]).select("lang", "doc_id", F.lit("first").alias("kind"))
    control = d.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("doc_id"), F.lit("control").alias("kind"))
    return first.unionByName(control)


FUNCTIONS = (
    agg_10_split_summary, agg_15_nearest_rank, agg_15_nearest_rank_list, agg_16_percentiles, agg_17_summary, agg_18_rates, agg_19_stage_counts, agg_20_strict_sum, agg_21_cost, agg_22_failed_buckets, agg_23_extrapolation, agg_26_subject_summary,
    agg_27_duplicates, agg_27_inventory, agg_30_bad_cases, agg_31_warnings, top_04_stratified, top_05_diverse, top_06_worst, leak_01_codes, jn_15_near_pairs, jn_15_ratio_pairs, leak_02_same_text, aud_01_labels, aud_03_order, jn_12_index_audit, ret_05_index_status,
    aud_04_fingerprint, snk_12_latest, snk_13_registration, snk_14_attribution, snk_15_resume, snk_16_roll_up, src_03_representatives, src_04_duplicate_keys, src_05_contiguous, src_05_runs, flt_06_exclusion, cmp_01_tolerance, cmp_03_outcomes, srt_02_pagination, smp_01_review,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*')"
_SQZ = "regexp_replace(lower(text), '\\s+', '', 'g')"
_G3 = "list_distinct(list_transform(range(1, greatest(length({s}) - 1, 2)), lambda i: substr({s}, i, 3)))"


def _plain_sql(text: str) -> str:
    """A text as leakage compares it."""
    for name, char in T.ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(lower({text}), '\\s+', '', 'g')"


_MD = "d AS (SELECT doc_id, md5(text) AS f FROM documents), st AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE f END AS f FROM d WHERE doc_id % 11 <> 0"
ORACLE = {
    "agg_10_split_summary": f"WITH a AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split, round(avg(value), 6) AS base, round(avg(value) FILTER (WHERE {_K} > 10), 6) AS system FROM events GROUP BY 1) SELECT *, round(system - base, 6) AS delta, round((system - base) / nullif(base, 0), 6) AS relative FROM a",
    "agg_15_nearest_rank": "WITH p AS (SELECT event_type, value, row_number() OVER w AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value)) SELECT event_type, max(value) FILTER (WHERE place = round_even((n - 1) * 0.5, 0) + 1) AS p50, max(value) FILTER (WHERE place = round_even((n - 1) * 0.95, 0) + 1) AS p95 FROM p GROUP BY 1",
    "agg_15_nearest_rank_list": "SELECT n_regionkey, list_sort(list(n_nationkey))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INT) + 1] AS p50 FROM nation GROUP BY 1",
    "agg_16_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "agg_17_summary": f"SELECT event_type, count(*) AS sample_count, count(v) AS known_count, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT *, CASE WHEN {_K} % 5 <> 0 THEN value END AS v FROM events) GROUP BY 1",
    "agg_18_rates": "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), 6) AS purchase_rate FROM events GROUP BY 1",
    "agg_19_stage_counts": "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("view", "signup", "error", "click", "purchase")) + f", count(*) FILTER (WHERE event_type = 'error' AND {_K} > 50) AS late_errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "agg_20_strict_sum": f"SELECT user_id, CAST(CASE WHEN count(v) = count(*) THEN sum(v) END AS BIGINT) AS total FROM (SELECT user_id, CASE WHEN user_id % 7 <> 0 OR {_K} > 3 THEN {_K} END AS v FROM events) GROUP BY 1",
    "agg_21_cost": f"SELECT event_id, CASE WHEN {_K} % 9 <> 0 THEN round(({_K} * 0.25 + {_K} * 2 * 1.5) / 1000, 6) END AS cost FROM events",
    "agg_22_failed_buckets": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) AS attempts, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 1",
    "agg_23_extrapolation": f"SELECT t.n AS target, round(t.n * s.k / s.n, 4) AS tokens, round(t.n * s.v / s.n, 2) AS value FROM (SELECT count(*) AS n FROM events) t, (SELECT count(*) AS n, CAST(sum({_K}) AS BIGINT) AS k, sum(value) AS v FROM events WHERE event_id % 10 = 0) s",
    "agg_26_subject_summary": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(count(*) FILTER (WHERE n_chars > 1000) / count(*), 6) AS long_rate FROM r WHERE rn = 1 GROUP BY 1",
    "agg_27_duplicates": "SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "agg_27_inventory": "SELECT lang, count(*) AS files, count(DISTINCT text) AS contents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1",
    "agg_30_bad_cases": "SELECT category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 8000 THEN 'long' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda x: x IS NOT NULL)) AS category FROM documents) GROUP BY 1",
    "agg_31_warnings": "WITH w AS (SELECT user_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'slow_error' ELSE 'error' END WHEN value > 50 THEN 'slow' END AS w FROM events), c AS (SELECT user_id, w, count(*) AS n FROM w WHERE w IS NOT NULL GROUP BY 1, 2) SELECT user_id, '{' || string_agg('\"' || w || '\":' || n, ',' ORDER BY w) || '}' AS warnings FROM c GROUP BY 1",
    "top_04_stratified": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn BETWEEN 3 AND 5",
    "top_05_diverse": "SELECT doc_id, source, CAST(tier AS INT) AS tier FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1 THEN 0 ELSE 1 END AS tier FROM documents) ORDER BY tier, n_chars DESC, doc_id LIMIT 30",
    "top_06_worst": "SELECT doc_id, CAST(contains(text, '!!') AS INT) AS shouting, n_chars FROM documents ORDER BY shouting DESC, n_chars DESC, doc_id LIMIT 10",
    "leak_01_codes": f"""WITH r AS (SELECT query_id, doc_id FROM ({bm25_sql('true', 3, False)})), f AS (SELECT query_id, min(doc_id) AS first FROM r GROUP BY 1), q AS (SELECT item_id AS query_id, {_plain_sql("text || CASE WHEN length(text) % 2 = 0 THEN ' doc-' || first || '-end' ELSE '' END")} AS q FROM benchmark JOIN f ON f.query_id = item_id),
        d AS (SELECT doc_id, {_plain_sql("text")} AS s, 'doc-' || doc_id || '-end' AS m FROM documents WHERE doc_id IN (SELECT doc_id FROM r)), g AS (SELECT *, {_G3.format(s="s")} AS gs FROM d), h AS (SELECT *, {_G3.format(s="q")} AS gq FROM q),
        c AS (SELECT query_id, doc_id, list_filter([CASE WHEN q = s THEN 'exact_copy' END, CASE WHEN contains(q, m) THEN 'metadata_in_query' END, CASE WHEN length(q) >= 32 AND length(s) >= 32 AND len(list_intersect(gq, gs)) >= 0.8 * (len(gq) + len(gs) - len(list_intersect(gq, gs))) THEN 'near_copy' END, CASE WHEN length(s) >= 24 AND (contains(s, q) OR contains(q, s)) THEN 'substring' END], lambda x: x IS NOT NULL) AS c FROM r JOIN h USING (query_id) JOIN g USING (doc_id))
        SELECT query_id, doc_id, array_to_string(c, ',') AS codes FROM c WHERE len(c) > 0""",
    "jn_15_near_pairs": f"WITH b AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, text FROM benchmark), a AS (SELECT * FROM b UNION ALL SELECT 'cut-' || doc_id, text[:-4] FROM b WHERE length(text) % 2 = 0), g AS (SELECT doc_id, {_G3.format(s=_SQZ)} AS g FROM a), p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.doc_id < b.doc_id AND least(len(a.g), len(b.g)) >= 0.8 * greatest(len(a.g), len(b.g))) SELECT * FROM p WHERE similarity >= 0.8",
    "jn_15_ratio_pairs": "WITH t AS (SELECT conv_id * 1000 + turn AS id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations) SELECT id AS a, id + 500000000 AS b, round((n - 1) / n, 6) AS similarity FROM t WHERE n BETWEEN 30 AND 199",
    "leak_02_same_text": f"WITH c AS (SELECT conv_id, text FROM conversations UNION ALL SELECT conv_id + 1000000, ' ' || replace(text, ' ', ' ' || chr(9)) FROM conversations WHERE conv_id % 10 = 0) SELECT md5({_SQZ}) AS fingerprint, count(*) AS n, min(conv_id) AS first FROM c GROUP BY 1 HAVING count(*) > 1",
    "aud_01_labels": "SELECT 'label_without_text' AS code, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 50) HAVING count(*) > 0 UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) HAVING count(*) > 0",
    "aud_03_order": "WITH s AS (SELECT event_type AS t, value AS v, lag(event_type) OVER w AS lt, lag(value) OVER w AS lv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), c AS (SELECT CASE WHEN t = lt AND v = lv THEN 'repeated' WHEN t < lt OR (t = lt AND v < lv) THEN 'not_monotone' END AS code FROM s) SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1",
    "jn_12_index_audit": f"WITH {_MD} UNION ALL SELECT doc_id + 1000000, f FROM d WHERE doc_id % 50 = 0), j AS (SELECT d.f AS e, st.f AS a FROM d FULL OUTER JOIN st USING (doc_id)) SELECT count(*) FILTER (WHERE e = a) AS matched, count(*) FILTER (WHERE a IS NULL) AS missing, count(*) FILTER (WHERE e IS NULL) AS stale, count(*) FILTER (WHERE e <> a) AS changed FROM j",
    "ret_05_index_status": f"WITH {_MD}), j AS (SELECT d.f AS e, st.f AS a FROM d FULL OUTER JOIN st USING (doc_id)) SELECT CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'stale' WHEN e <> a THEN 'incompatible' ELSE 'ready' END AS status, count(*) AS n FROM j GROUP BY 1",
    "aud_04_fingerprint": """WITH h AS (SELECT sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation) SELECT count(*) AS n, sha256(sum(CAST('0x' || h[1:15] AS HUGEINT)) || ':' || sum(CAST('0x' || h[16:30] AS HUGEINT))) AS fingerprint FROM h""",
    "snk_12_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "snk_13_registration": "SELECT CASE WHEN doc_id % 3 <> 0 THEN 'insert' WHEN doc_id % 30 = 0 THEN 'conflict' ELSE 'valid' END AS plan, count(*) AS n FROM documents GROUP BY 1",
    "snk_14_attribution": "WITH o AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS kb FROM documents WHERE doc_id % 9 <> 0 UNION ALL SELECT doc_id, 'zz' FROM documents WHERE doc_id % 25 = 1), g AS (SELECT doc_id, count(DISTINCT kb) AS n, min(kb) AS owner FROM o GROUP BY 1), j AS (SELECT CASE WHEN d.doc_id % 4 <> 0 THEN lang END AS kb, n, owner, CASE WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS state FROM documents d LEFT JOIN g USING (doc_id)) SELECT state, CASE WHEN state <> 'mapped' THEN 'none' WHEN kb IS NULL THEN 'update' WHEN kb = owner THEN 'ok' ELSE 'conflict' END AS action, count(*) AS n FROM j GROUP BY 1, 2",
    "snk_15_resume": "WITH i AS (SELECT o_custkey AS document_id, bool_and(o_totalprice <= 499000) AS done FROM orders GROUP BY 1) SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'new' WHEN document_id % 7 <> 0 AND done THEN 'reuse' ELSE 'rebuild' END AS decision FROM i",
    "snk_16_roll_up": "WITH c AS (SELECT o_custkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_totalprice > 450000 THEN 'failed' WHEN o_totalprice < 5000 THEN 'deferred' ELSE 'completed' END AS s FROM orders), g AS (SELECT document_id, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'deferred') AS deferred, count(*) AS n FROM c GROUP BY 1) SELECT document_id, completed, failed, deferred, CASE WHEN completed = n THEN 'completed' WHEN deferred > 0 THEN 'provider_blocked' ELSE 'failed' END AS status FROM g",
    "src_03_representatives": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents WHERE n_chars > 0) WHERE rn = 1",
    "src_04_duplicate_keys": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "src_05_contiguous": "SELECT conv_id, count(*) AS n, max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AND min(turn) = 0 AS ok FROM conversations GROUP BY 1",
    "src_05_runs": "WITH k AS (SELECT row_number() OVER () AS i, CASE WHEN conv_id % 7 = 0 THEN 'seventh' ELSE CAST(conv_id AS VARCHAR) END AS key FROM conversations), b AS (SELECT *, CAST(key IS DISTINCT FROM lag(key) OVER (ORDER BY i) AS INT) AS begins FROM k), r AS (SELECT key, sum(begins) OVER (ORDER BY i) AS run FROM b), n AS (SELECT key, run, count(*) AS n FROM r GROUP BY 1, 2) SELECT key, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n, max(n) AS longest FROM n GROUP BY 1",
    "flt_06_exclusion": f"WITH d AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents), l AS (SELECT * FROM d WHERE length(term) > 12), i AS (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) SELECT DISTINCT doc_id FROM l WHERE term IN (SELECT term FROM i WHERE item_id % 2 = 0) AND doc_id NOT IN (SELECT doc_id FROM l WHERE term IN (SELECT term FROM i WHERE item_id % 2 = 1))",
    "cmp_01_tolerance": "SELECT abs(o_totalprice - n) <= greatest(1e-6, 1e-9 * greatest(abs(o_totalprice), abs(n), 1.0)) AS equal, count(*) AS n FROM (SELECT o_totalprice, o_totalprice * (1 + CASE WHEN o_orderkey % 2 = 0 THEN 1e-10 ELSE 1e-8 END) AS n FROM orders) GROUP BY 1",
    "cmp_03_outcomes": "SELECT CASE WHEN event_type = 'error' THEN CASE WHEN value > 20 THEN 'execution_failure' ELSE 'validation_failure' END WHEN event_type = 'purchase' THEN CASE WHEN value > 30 THEN 'success' ELSE 'result_mismatch' END ELSE 'not_applicable' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "srt_02_pagination": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20",
    "smp_01_review": "SELECT lang, doc_id, 'first' AS kind FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS rn FROM documents WHERE n_chars > 20) WHERE rn = 1 UNION ALL SELECT DISTINCT lang, CAST(-1 AS BIGINT), 'control' FROM documents WHERE n_chars > 20",
}
