"""Operators on small hand-made tables."""

import json
import random
import re
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import audits, blocks, branches, candidates, comparisons, dense, fusion, graph, lifecycle, linking, metrics, sparse
from lorespark.operators import sqlgate as gate
from lorespark.sources import catalog
from lorespark.streaming import usage


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_mixed_script_tokens():
    assert T.mixed_tokens("CO2浓度") == ["co2", "浓", "度", "浓度"]
    assert T.mixed_tokens("a.b-c_d ß9") == ["a.b-c_d", "ss9"]
    assert T.mixed_tokens("x..y") == ["x", "y"]
    assert T.mixed_tokens(None) == []


def test_native_tokens(spark):
    df = spark.createDataFrame([("a.b-c_d ß9 x..y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["a.b-c_d", "ß9", "x", "y"], [], None]
    assert df.select(T.mixed_script_tokens(F.col("t")).alias("x")).first()[0][0] == "a.b-c_d"


def test_name_uuid(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    df = spark.createDataFrame([("a",), ("doc:7",), ("é",)], "n string").select("n", T.name_uuid(ns, F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.UUID(ns), r.n)) for r in df.collect())


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    got = df.select(T.canonical_json({"b": F.col("b"), "a": F.col("a"), "c": F.col("c")})).first()[0]
    assert got == json.dumps({"a": None, "b": 1, "c": "x"}, separators=(",", ":"), sort_keys=True)


def test_bm25_ties_and_scope(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d"), (4, ""), (5, None)], "id int, text string")
    queries = spark.createDataFrame([(9, "a a"), (8, "  ")], "q int, text string")
    got = rows(sparse.bm25(queries, docs, "id", "q"), "rank")
    assert [(r[0], r[1], r[4]) for r in got] == [(9, 1, 1), (9, 2, 2)] and got[0][2] == got[1][2] > 0
    assert sparse.bm25(queries, docs.limit(0), "id", "q").count() == 0


def test_bm25_splits_chunks_once(spark):
    """search reads its index several times; the chunks' tokens are made once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(x):
        if x and x.startswith("chunk"):
            seen.add(1)
        return (x or "").split()

    docs = spark.createDataFrame([(1, "chunk a b"), (2, "chunk b"), (3, "chunk c d"), (4, None)], "id int, text string")
    queries = spark.createDataFrame([(9, "b d")], "q int, text string")
    got = rows(sparse.bm25(queries, docs, "id", "q", tokens=split), "rank")
    assert [(r[1], r[3]) for r in got] == [(3, ["d"]), (2, ["b"]), (1, ["b"])] and seen.value == 3


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0])], "id int, vector array<float>")
    assert rows(dense.vector_faults(v, "id", "vector", 2), "id") == [(4, "norm"), (5, "dimension")]
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id int, query_vector array<float>")
    want = [(7, 1, 1.0, 1), (7, 3, 1.0, 2), (8, 2, 1.0, 1), (8, 1, 0.0, 2)]
    assert rows(dense.top_k(q, v.where("id < 4"), "id", 2), "query_id", "rank") == want
    assert rows(dense.top_k(q, v.where("id < 4"), "id", 2, most_queries=1), "query_id", "rank") == want


def test_rrf(spark):
    run = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, k string, rank int")
    got = rows(fusion.rrf(run(["b", "a"]), run(["b", "c"]), "k"), "rank")
    assert [(r[1], r[2], r[3]) for r in got] == [("b", round(2 / 61, 12), "both"), ("a", round(1 / 62, 12), "vector"), ("c", round(1 / 62, 12), "graph")]


def test_fair_pool_is_round_robin(spark):
    random.seed(3)
    for _ in range(4):
        branches = {b: random.sample("abcdefghij", random.randint(0, 6)) for b in fusion.BRANCHES}
        left, want = {b: list(v) for b, v in branches.items()}, []
        while any(left.values()):
            for b in fusion.BRANCHES:
                if left[b] and (k := left[b].pop(0)) not in want:
                    want.append(k)
        frames = {b: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(v)], "query_id int, k string, rank int") for b, v in branches.items()}
        assert [r[1] for r in rows(fusion.fair_pool(frames, "k", 5), "rank")] == want[:5]


def test_context(spark):
    items = spark.createDataFrame([(1, "a", 1, "x" * 6, ["p"]), (1, "b", 2, "y" * 8, ["q"]), (1, "c", 3, "z" * 4, ["r"]), (1, "d", 4, "", ["s"]), (1, "e", 5, "X" * 6, ["p"])], "query_id int, id string, rank int, text string, blocks array<string>")
    assert rows(fusion.pack_context(items, 10), "marker") == [(1, "a", "C1", 6), (1, "c", "C2", 4)]
    assert [r[1] for r in rows(fusion.pack_context(items, 100), "marker")] == ["a", "b", "c"]


def test_context_gathers_only_what_may_fit(spark):
    items = spark.createDataFrame([(1, "a", 1, "x" * 90000, ["p"]), (1, "b", 2, "y" * 8, ["q"]), (1, "c", 3, None, ["r"]), (1, "d", 4, " ", ["s"]), (1, "e", 5, "z", ["p"]), (2, "a", 1, "x" * 11, ["p"])], "query_id int, id string, rank int, text string, blocks array<string>")
    packed = fusion.pack_context(items, 10)
    assert rows(packed, "marker") == [(1, "b", "C1", 8), (1, "e", "C2", 1)]
    below = packed._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert re.search(r"Filter .*length\(text#\d+\) <= 10", below)


def test_rerank_refuses_nan(spark):
    c = spark.createDataFrame([(1, "a", 0.5), (1, "b", float("nan"))], "query_id int, k string, s double")
    with pytest.raises(Exception, match="not finite"):
        fusion.rerank(c, "k", lambda df: df["s"]).collect()


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id int, k string, rank int")
    gold = spark.createDataFrame([(1, "b")], "query_id int, k string")
    m = metrics.query_metrics(spark.createDataFrame([(1,), (2,)], "query_id int"), run, gold, "k").orderBy("query_id").collect()
    assert (m[0].first_rank, m[0].hit_1, m[0].hit_3, m[0].mrr) == (2, 0, 1, 0.5) and (m[1].first_rank, m[1].mrr, m[1].recall_10) == (None, 0.0, 0.0)
    assert rows(metrics.raw_hits(run, gold, "k"))[0][1:3] == (0, 1)


def test_percentiles_and_sums(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int")
    assert df.agg(metrics.nearest_rank(F.col("x"), 0.5)).first()[0] == 30
    assert df.agg(F.percentile("x", 0.5)).first()[0] == 25
    assert df.limit(0).agg(metrics.nearest_rank(F.col("x"), 0.5)).first()[0] is None
    none = spark.createDataFrame([(1,), (None,)], "x int")
    assert none.agg(metrics.strict_sum("x")).first()[0] is None and none.limit(0).agg(metrics.strict_sum("x")).first()[0] is None
    assert df.agg(metrics.strict_sum("x")).first()[0] == 100
    assert metrics.same_rows(df, df.orderBy(F.desc("x"))) and not metrics.same_rows(df, df.union(df))


def test_sections_and_chunks(spark):
    spec = [("title", "T1"), ("title", "T2"), ("text", "p1"), ("title", "T3"), ("text", "p2"), ("title", "T4")]
    b = spark.createDataFrame([("k", "d", 1, i, f"b{i}", t, x) for i, (t, x) in enumerate(spec)], "kb_id string, document_id string, page_number int, reading_order int, block_id string, type string, text string")
    s = blocks.sectioned(b)
    assert [r[3] for r in rows(blocks.section_paths(s), "section")] == [["T1", "T2"], ["T3"], ["T4"]]
    c = blocks.chunked(s)
    assert [r.text for r in c.orderBy("ordinal").collect()] == ["## T1\n\n## T2\n\np1", "## T3\n\np2", "## T4"]
    assert blocks.lineage_faults(c, b).count() == 0
    assert rows(blocks.lineage_faults(c.where("ordinal > 0"), b)) == [("uncovered_block", 3)]


def test_lines_lose_spaces_at_their_ends_only(spark):
    docs = spark.createDataFrame([(1, "0 call 555-8630\n 1 of 11 \n \n22 a2")], "doc_id long, text string")
    b = blocks.text_blocks(docs, "doc_id", "text", F.lit("k")).orderBy("block_id")
    assert [r.text for r in b.collect()] == ["0 call 555-8630", "1 of 11", "22 a2"]


def test_metrics_by_class_are_those_of_their_gold(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "z")], "query_id int, label string")
    items = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None), (14, "c"), (15, "a")], "key int, label string")
    run = spark.createDataFrame([(1, 12, 1), (1, 10, 2), (1, 10, 3), (1, 11, 5), (2, 13, 1), (2, 12, 4), (3, 10, 1), (4, 13, 1), (5, 14, 1)], "query_id int, key int, rank int")
    gold = queries.join(items, "label").select("query_id", "key")
    assert rows(metrics.class_metrics(queries, run, items, "key", "label"), "query_id") == rows(metrics.query_metrics(queries, run, gold, "key"), "query_id")
    judged = metrics.of_class(run, queries, items, "key", "label")
    assert rows(metrics.judged_hits(judged), "query_id") == rows(metrics.raw_hits(run, gold, "key"), "query_id")


def test_dense_keeps_the_best_of_a_task(spark, monkeypatch):
    r = random.Random(3)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(3000)] + [(5000 + i, [0.9] * 8) for i in range(40)]
    df = spark.createDataFrame(vectors, "id int, vector array<double>").coalesce(1)
    queries = df.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(dense, "CELLS", 700)
    got = dense.top_k(queries, df, "id", 12)
    want = []
    for q, v in vectors:
        if q % 500 == 0:
            scores = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 5), i) for i, w in vectors)[:12]
            want += [(q, i, n + 1) for n, (_, i) in enumerate(scores)]
    assert sorted((x.query_id, x.id, x["rank"]) for x in got.collect()) == sorted(want)


def test_scored_pairs_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c") for i in range(30)], "id long, text string")
    queries = spark.createDataFrame([(1, "a c"), (2, "b1 a")], "q int, text string")
    found = sparse.search(queries, sparse.index_rows(docs, "id"), "id", "q", limit=4, matched=False)
    assert "hashpartitioning(query_id#" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    assert [r.id for r in found.where("query_id = 2").orderBy("rank").collect()] == [1, 4, 7, 10]


def test_split_is_lossless():
    random.seed(1)
    for _ in range(200):
        text = "".join(random.choice("ab c.!\n") for _ in range(random.randint(0, 300)))
        parts = blocks.split_text(text, 40)
        assert "".join(parts) == text and all(len(p) <= 40 for p in parts)
    assert blocks.split_text("aa! bb cc", 5) == ["aa!", " bb ", "cc"]


def test_html_table(spark):
    assert blocks.table_text("<table><tr><th>a </th><td>b\n c</td></tr><tr><td>d</td></tr></table>") == "a | b c\nd"
    assert blocks.table_text("<p>only text</p>") == "only text" and blocks.table_text(None) is None
    df = spark.createDataFrame([("<tr><td>1</td></tr>",)], "m string")
    assert df.select(blocks.rendered_table(F.col("m"))).first()[0] == "1"


def test_adapted(spark):
    items = spark.createDataFrame(
        [("d", 0, "header", 0, "h", None, None, [], None, None), ("d", 1, "text", 0, "T", 1, None, [], None, [0.0, 0.0, 500.0, 1001.0]), ("d", 2, "table", 0, None, None, "<table></table>", ["c"], None, None), ("d", 3, "equation", 1, "x^2", None, None, [], "i.png", None)],
        "document_id string, pos int, type string, page_idx int, text string, text_level int, table_body string, captions array<string>, img_path string, bbox array<double>",
    )
    got = blocks.adapted(items).orderBy("page_number", "reading_order").collect()
    assert [(r.block_id, r.type) for r in got] == [("p1-b0", "title"), ("p1-b1", "table"), ("p2-b0", "formula")]
    assert got[0].bbox == [0.0, 0.0, 0.5, 1.0] and got[1].html and got[2].latex == "x^2"


def test_graph_score(spark):
    df = spark.createDataFrame([(1.0, 1, "relation"), (0.5, 0, "seed"), (1.0, 0, "seed")], "s double, h int, k string")
    assert [r[0] for r in df.select(graph.score(F.col("s"), F.col("h"), F.col("k"))).collect()] == [0.94, 0.64, 1.0]


def test_traversal_with_bridge(spark):
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id int, entity_id string, score double")
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "c", "a")], "relation_id string, source_entity_id string, target_entity_id string")
    mem = spark.createDataFrame([("b", "X"), ("z", "X")], "local_entity_id string, canonical_entity_id string")
    p = graph.traverse(seeds, graph.edges(rel, mem), 2)
    assert {tuple(r.nodes) for r in p.collect()} == {("a",), ("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "b", "z"), ("a", "c", "b")}
    assert {r.kind for r in p.where("hop = 2").collect()} == {"relation", "mixed"}
    with pytest.raises(ValueError):
        graph.traverse(seeds, graph.edges(rel), 3)


def test_generic_terms(spark):
    q = spark.createDataFrame([(1, "the red ring")], "query_id int, text string")
    t = spark.createDataFrame([("e1", "red"), ("e2", "ring"), ("e3", "ring"), ("e4", "the red ring")], "entity_id string, term string")
    assert [(r[1], r[2]) for r in rows(graph.seeds(q, t, generic=1), "rank")] == [("e4", "exact_local_name"), ("e1", "contains_local_name")]


def test_linking(spark):
    e = spark.createDataFrame([("1", "Acme", ["ACME Inc"], "org", "d1"), ("2", "acme inc", [], "org", "d2"), ("3", "Acorn", [], "org", "d1"), ("4", "ACME", [], "person", "d1")], "entity_id string, name string, aliases array<string>, type string, document_id string")
    assert {(r.a, r.b) for r in linking.candidates(e).collect()} == {("1", "2"), ("1", "4")}
    pairs = linking.candidates(e, similar=None).select("a", "b").distinct()
    s = linking.signals(pairs, e)
    got = {(r.a, r.b): (r.decision, r.reason) for r in linking.decisions(s).collect()}
    assert got[("1", "2")] == ("UNCERTAIN", "needs_adjudication") and got[("1", "4")] == ("NO_LINK", "type_mismatch")
    assert got[("1", "3")] == ("NO_LINK", "no_shared_signal") and all(d != "LINK" for d, _ in got.values())
    assert s.where("a = '1' and b = '3'").first().similarity == round(SequenceMatcher(None, "acme", "acorn").ratio(), 6)


def test_components_chain(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in linking.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_near_pairs_lose_none(spark):
    random.seed(5)
    base = ["".join(random.choice("abcd ") for _ in range(60)) for _ in range(6)]
    texts = [b[: random.randint(50, 60)] + random.choice(["", "x"]) for b in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    plain = [t.replace(" ", "").lower() for t in texts]
    grams = [{s[i : i + 3] for i in range(max(1, len(s) - 2))} for s in plain]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    assert {(r.a, r.b) for r in audits.near_pairs(df, "id", "t", 0.8).collect()} == want


def test_leakage(spark):
    q = spark.createDataFrame([(1, "What is  X &amp; y"), (2, "a" * 30 + "b"), (3, "see m-1 here"), (4, "".join(map(chr, range(97, 123))) * 2), (5, "")], "query_id long, query string")
    s = spark.createDataFrame([(1, "what is x & Y", "m0"), (2, "zz" + "a" * 30 + "bq", ""), (3, "other", "M-1"), (4, "".join(map(chr, range(97, 123))) * 2 + "!", None), (5, "", "m")], "doc_id long, source string, m string")
    pairs = spark.createDataFrame([(i, i) for i in range(1, 6)], "query_id long, doc_id long")
    got = {r.query_id: r.codes for r in audits.leakage(pairs, q, s, metadata=["m"]).collect()}
    assert got == {1: ["exact_copy"], 2: ["substring"], 3: ["metadata_in_query"], 4: ["near_copy", "substring"], 5: []}


def test_ngrams_of_long_texts_take_linear_time(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("ab漢d" * (n // 4),)], "t string")
        began = time.time()
        assert df.select(F.size(T.character_ngrams(F.col("t")))).first()[0] == 4
        return time.time() - began

    took(1000)
    assert took(400_000) < 30


def test_quotas():
    assert sum(dict([("a", 3), ("b", 5), ("c", 4)])[g] for g in audits.quotas([("a", 3), ("b", 5), ("c", 4)], 7)) == 7
    with pytest.raises(ValueError):
        audits.quotas([("a", 3)], 2)


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    f = lambda d: audits.table_fingerprint(d).first()
    assert f(df) == f(df.repartition(5).select("x", "id")) and f(df) != f(df.where("id > 0"))


ACCEPTED = ["SELECT c_name FROM customer", "SELECT count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "WITH x AS (SELECT c_custkey AS k FROM customer) SELECT k FROM x UNION SELECT n_nationkey FROM nation", "SELECT c_name FROM customer WHERE c_name LIKE 'A%' ORDER BY c_name LIMIT 5", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer", "SELECT c_custkey FROM customer WHERE c_name = 'drop table; --'", "SELECT array_length(array_agg(c_custkey), 1) AS n, json_build_object('k', max(c_name)) AS j FROM customer", "SELECT c_acctbal::int AS x, sum(c_acctbal) OVER w AS s FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "SELECT * FROM (VALUES (1), (2)) AS v(a)", "SELECT c_custkey % 3 AS m, count(*) FILTER (WHERE c_acctbal > 0) AS n FROM customer WHERE c_acctbal BETWEEN 1 AND 5000 AND c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY ROLLUP(c_custkey % 3) HAVING count(*) > 1", "SELECT trim(BOTH 'x' FROM c_name) AS t, position('a' IN c_name) AS p, extract(year FROM current_date) AS y FROM customer", "WITH /* c */ nation AS (SELECT 1 AS k) SELECT k FROM nation"]
REFUSED = {"SELECT `reflect`('java.lang.System','getProperty','user.home') FROM nation": "function", "SELECT `java_method`('java.lang.System','getProperty','user.home') FROM nation": "function", "SELECT `ntile`(2) OVER (ORDER BY n_name) FROM nation": "function", "SELECT current_user FROM nation": "function", "SELECT n_nationkey div 2 FROM nation": "operator", "SELECT n_nationkey & 1 FROM nation": "operator", "SELECT n_name FROM nation WHERE n_name RLIKE 'a'": "operator", "SELECT sum(n_nationkey) OVER w FROM nation WINDOW w AS (ORDER BY `reflect`('java.lang.System','getProperty','user.home'))": "function", "SELECT json_agg(n_name) FROM nation": "function", "SELECT transform(array_agg(n_name), x -> x) FROM nation": "forbidden", "SELECT `to_json`(named_struct('a', 1)) FROM nation": "function", "SELECT n_name FROM nation ORDER BY `reflect`('java.lang.System','getProperty','user.home')": "function", "SELECT n.n_name FROM nation n JOIN customer c ON c.c_name = `java_method`('java.lang.System','getProperty','user.home')": "function", "SELECT CAST(array_agg(n_name) AS array<string>) FROM nation": "operator", "SELECT * EXCEPT (n_name) FROM nation": "operator", "SELECT IDENTIFIER('abs')(1) FROM nation": "operator", "DELETE FROM customer": "not_a_query", "SELECT 1; SELECT 2": "several_statements", "SELECT * FROM secret": "unknown_table", "SELECT sleep(5) FROM customer": "function", "SELECT pg.abs(1) FROM customer": "function", "SELECT c_acctbal / 2 FROM customer": "operator", "SELECT c_name FROM customer LIMIT 5 OFFSET 3": "forbidden", "SELECT * FROM (SELECT * FROM customer LIMIT 3) t": "nested_limit", "SELECT * FROM customer TABLESAMPLE (5 PERCENT)": "forbidden", "WITH RECURSIVE r AS (SELECT 1 AS n) SELECT n FROM r": "forbidden", "": "empty", "SELECT c_name FROM customer LIMIT ALL": "limit", "SELECT explode(array(1)) FROM customer": "function", "SELECT CASE WHEN true THEN 1 END FROM customer": "operator", "SELECT c_name FROM customer GROUP HAVING (": "syntax", "INSERT INTO customer SELECT * FROM nation": "not_a_query", "SELECT c_wrong FROM customer": "unknown_column"}


@pytest.fixture
def gated(spark, sf):
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "nation")}
    return lambda sql, log=lambda r: None, **kw: gate.execute(spark, sql, gate.Policy(frozenset(tables), **kw), tables, log)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_gate_accepts(gated, sql):
    assert gated(sql).columns


@pytest.mark.parametrize("sql", REFUSED)
def test_gate_refuses(gated, sql):
    with pytest.raises(gate.Rejected) as e:
        gated(sql)
    assert e.value.category == REFUSED[sql], e.value


def test_gate_leaves_views_alone(spark, gated):
    spark.range(3).createOrReplaceTempView("nation")
    spark.range(2).createOrReplaceTempView("hidden")
    try:
        assert len(gated("SELECT n_name FROM nation").rows) == 25 and spark.table("nation").count() == 3
        with pytest.raises(gate.Rejected):
            gated("SELECT (SELECT max(id) FROM (WITH hidden AS (SELECT 1 AS id) SELECT id FROM hidden)) AS a, id FROM hidden")
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("gated_")]
    finally:
        spark.catalog.dropTempView("nation")
        spark.catalog.dropTempView("hidden")


def test_gate_bounds(gated):
    log = []
    r = gated("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", log.append, max_rows=3)
    assert len(r.rows) == 3 and r.truncated == "rows" and [x["state"] for x in log] == ["created", "validated", "executing", "succeeded"]
    assert gated("SELECT c_custkey FROM customer LIMIT 900", max_rows=5).limit_source == "clamped"
    assert gated("SELECT c_name FROM customer", max_bytes=60).truncated == "bytes"
    assert gate.redacted("SELECT 'x', 12.5, true FROM t1 WHERE a = 'it''s'") == "SELECT '<redacted>', 0, false FROM t1 WHERE a = '<redacted>'"
    text, omitted = gate.schema_context({"a": [("x", "int")], "b": [("y" * 50, "int")], "c": [("z", "int")]}, [("a", "x", "c", "z"), ("a", "x", "b", "y")], 50)
    assert omitted == ["b"] and "a.x -> c.z" in text


def test_generations(spark, tmp_path):
    g = lifecycle.Generations(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, x int")
    first = g.build(df, {"v": 1})
    assert g.build(df, {"v": 1}) == first == g.active() and g.read().count() == 2
    g.replace(spark.createDataFrame([("d1", 5), ("d1", 6)], "document_id string, x int"), "d1", {"v": 1})
    assert sorted(r.x for r in g.read().collect()) == [2, 5, 6]
    assert g.delete("d1", {"v": 1}) == 2 and g.delete("d1", {"v": 1}) == 0 and g.read().count() == 1
    kept = lambda: len([p for p in tmp_path.iterdir() if p.name.startswith("gen=")])
    assert kept() == 3 and g.prune(1) == 2 and kept() == 1 and g.read().count() == 1
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("aside")]
    with pytest.raises(ValueError):
        g.replace_documents(spark.createDataFrame([("d2", 1), ("d2", 1)], "document_id string, x int"), {"v": 1}, identity="x")
    assert g.read().count() == 1 and kept() == 1


def test_branches(spark):
    import time

    rows_ = spark.range(2).toDF("key")
    missing = lambda: spark.read.parquet("file:///no/such/index")

    def slowly(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def mistaken():
        raise KeyError("x")

    began = time.monotonic()
    slow = lambda: rows_.repartition(2).mapInPandas(slowly, "key long")
    out = branches.run(spark, {"a": lambda: rows_, "b": missing, "c": slow, "d": lambda: rows_.where("false"), "e": lambda: rows_.where("key = 1")}, rows_.where("false"), {"a": 60, "b": 60, "c": 3, "d": 60, "e": 60})
    assert {n: o.status for n, o in out.items()} == {"a": "success", "b": "failed", "c": "timed_out", "d": "empty", "e": "success"}
    assert time.monotonic() - began < 40 and out["c"].rows.count() == 0 and out["b"].error == "AnalysisException"
    assert rows(branches.fused(out, "key"), "key") == [(0, "a", "b", "c"), (1, "a,e", "b", "c")]
    tracker = spark.sparkContext.statusTracker()
    for _ in range(50):  # the late branch's job is cancelled, not left to run
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()
    for bad, error in ((mistaken, KeyError), (missing, Exception)):
        with pytest.raises(error):
            branches.run(spark, {"a": lambda: rows_, "b": bad}, rows_, strict=True)
    with pytest.raises(KeyError):  # a mistake isn't an outcome
        branches.run(spark, {"a": lambda: rows_, "b": mistaken}, rows_)
    with pytest.raises(branches.AllFailed):
        branches.run(spark, {"b": missing}, rows_)


def test_lineage_and_scope(spark):
    rows_ = spark.range(2).toDF("key")
    with pytest.raises(Exception, match="no lineage"):
        candidates.with_lineage(rows_, rows_.where("key = 0"), "key").collect()
    with pytest.raises(ValueError):
        candidates.scoped(rows_, "")


def test_facts(spark):
    rows_ = [("a", 1.0), ("b", 2.0000000001), ("a", 1.0)]
    asked = {0: [], 1: [{"n": "a"}, {"n": "a", "x": 1.0}], 2: [{"n": "a"}] * 3, 3: [{"x": 2.0}], 4: [{}], 5: [{"y": 1.0}], 6: [{"n": "c"}], 7: [{"n": "b"}, {"x": 2.0}]}
    cell = lambda v: (v, None) if isinstance(v, float) else (None, v)
    facts = [(c, i, k, *cell(v)) for c, fs in asked.items() for i, f in enumerate(fs) for k, v in (f.items() if f else [(None, None)])]
    results = [(c, i, k, *cell(v)) for c in asked for i, r in enumerate(rows_) for k, v in zip(("n", "x"), r)]
    results += [(8, 0, "n", None, "a"), (8, 0, "n", None, "a")]
    facts += [(8, 0, "n", None, "a"), (9, 0, None, None, None)]
    cases = spark.createDataFrame([(c,) for c in range(10)], "case_id int")
    f = spark.createDataFrame(facts, "case_id int, fact int, column string, number double, string string")
    r = spark.createDataFrame(results, "case_id int, row int, column string, number double, string string")
    got = {x.case_id: x.holds for x in comparisons.facts_hold(cases, f, r).collect()}
    assert got == {0: None, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 9: True}


def test_seeds_of_any_script(spark):
    terms = spark.createDataFrame([("e1", "Москва", "local_name", None), ("e2", "北京", "local_alias", None), ("e3", "moscow city", "local_name", None), ("e3", "Moskow", "canonical_alias", "c9"), ("e4", "art", "local_name", None)], "entity_id string, term string, kind string, canonical_id string")
    q = spark.createDataFrame([(1, "где Москва сейчас"), (2, "我在北京住"), (3, "moscow citi"), (4, "party time"), (5, "Moskow")], "query_id int, text string")
    got = [(r.query_id, r.entity_id, r.method, r.score, r.canonical_id) for r in graph.seeds(q, terms).orderBy("query_id", "rank").collect()]
    assert got == [(1, "e1", "contains_local_name", 0.93, None), (2, "e2", "contains_local_alias", 0.93, None), (3, "e3", "lexical_local_name", round(20 / 22 * 0.88, 6), None), (5, "e3", "exact_canonical_alias", 1.0, "c9")]


def test_mixed_tokens():
    cases = {"bge-m3 2024 x_i": ["bge-m3", "2024", "x_i"], "中文检索ok": ["中", "文", "检", "索", "中文", "文检", "检索", "ok"], "a..b a.": ["a", "b", "a"], "ｆｕｌｌ Straße": ["full", "strasse"], "かな한글": ["かな한글"], "v.中": ["v.", "中"], "": []}
    assert {k: T.mixed_tokens(k) for k in cases} == cases


def test_search_with_mixed_tokens(spark):
    chunks = spark.createDataFrame([(1, "中文检索 works"), (2, "other text"), (3, None), (4, "中 国")], "id int, text string")
    q = spark.createDataFrame([(7, "检索"), (8, "中"), (9, "   ")], "qid int, text string")
    got = [(r.query_id, r.id) for r in sparse.bm25(q, chunks, "id", "qid", tokens=T.mixed_script_tokens).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1), (8, 4), (8, 1)]


def test_command_line(capsys, spark, sf, tmp_path):
    from lorespark.__main__ import main

    assert main(["list"]) == 0 and "ret_04_bm25" in capsys.readouterr().out
    assert main(["run", "no_such", sf]) == 2
    assert main(["run", "cmp_02_facts", sf, str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 25


def test_documents_source(spark, tmp_path):
    block = {"type": "table", "page_number": 1, "reading_order": 0, "block_id": "b0", "markdown": "a", "html": "b"}
    (tmp_path / "d.json").write_text(json.dumps({"document_id": "d", "filename": "f", "pages": [{"page_number": 1, "blocks": [block]}]}, indent=1))
    (tmp_path / "log.jsonl").write_text('{"k":"a","seq":1}\n{"k":"a","seq":2}\n{"k":"b","s')
    assert rows(catalog.faults(catalog.documents(spark, str(tmp_path / "d.json")))) == [("d", "b0", "two_bodies")]
    log = catalog.jsonl(spark, str(tmp_path / "log.jsonl"), "k string, seq int")
    assert rows(audits.latest(log.withColumn("v", F.col("seq")), "k", "seq")) == [("a", 2, 2)]
    assert rows(catalog.inventory(spark, str(tmp_path), "*.json").select("size_bytes"))[0][0] > 10


def test_stream_equals_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    q = usage.buckets(usage.read_events(spark, str(tmp_path / "in"), 1), 60).writeStream.format("memory").queryName("b").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("b"), "bucket") == rows(usage.buckets(ev, 60), "bucket")


def test_blocked_runs(spark):
    df = spark.createDataFrame([("r", 1, "a", False), ("r", 2, "a", False), ("r", 3, "a", False), ("s", 1, "a", False), ("s", 2, "b", False), ("s", 3, "a", False), ("t", 1, "a", True), ("t", 2, "a", True), ("t", 3, "a", True)], "run_id string, seq int, signature string, retryable boolean")
    assert rows(usage.blocked_runs(df)) == [("r", "a")]


def test_places_of_chunks_are_read_without_their_texts(spark):
    b = spark.createDataFrame([("k", "d", 1, i, f"b{i}", "text", "x" * 900) for i in range(5)], "kb_id string, document_id string, page_number long, reading_order long, block_id string, type string, text string")
    chunks = blocks.chunked(blocks.sectioned(b))
    plan = chunks.select("block_ids")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "shown" in line]
    assert [len(r.text) for r in chunks.orderBy("ordinal").collect()] == [900, 900, 900, 900, 900]
