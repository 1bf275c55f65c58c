"""Filters, lineage, candidates, extraction outputs, comparisons and frames over the test tables, with their SQL.

Documents stand for representations (their language is the knowledge base, their source the document), orders for chunks with their
lines as pages and blocks, and JSON made from document ids for outputs of a model.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions.scratch import shared_folder
from lorespark.operators import branches
from lorespark.operators import candidates as C
from lorespark.operators import comparisons as X
from lorespark.operators import extraction as E
from lorespark.operators import lifecycle as L
from lorespark.operators import manifests
from lorespark.operators.dense import vector_faults
from lorespark.sources import catalog
from lorespark.sources.tables import table as _t
from lorespark.streaming import frames


def _index(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    modality = F.element_at(F.array(*map(F.lit, ("text", "table", "image"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", F.col("lang").alias("knowledge_base_id"), F.col("source").alias("document_id"), modality.alias("modality"), (F.col("doc_id") % 4 != 0).alias("searchable"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7 == 0).alias("quarantined"))


def flt_01_scope(spark, sf_dir):
    return C.scoped(_index(spark, sf_dir), "en").select("doc_id", "document_id", "modality")


def flt_01_scope_narrow(spark, sf_dir):
    return C.scoped(_index(spark, sf_dir), "de", "src3", "text", quarantined=True).select("doc_id")


def flt_07_text_present(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" \t ")).otherwise(F.col("text")))
    return C.with_text(d).groupBy("lang").agg(F.count("*").alias("n"))


def flt_08_question_gates(spark, sf_dir):
    q = F.element_at(F.array(F.col("text"), F.lit("   "), F.lit("why?"), F.lit("12345 67890 ???"), F.lit("a b a b a b a b a b a b")), (F.col("item_id") % 5 + 1).cast("int"))
    b = _t(spark, sf_dir, "benchmark").withColumn("item_id", F.regexp_replace(F.col("item_id").cast("string"), r"\D", "").cast("long"))
    return b.select("item_id", C.first_failing(C.question_rules(q)).alias("code"))


def jn_02_missing_lineage(spark, sf_dir):
    scores = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    chunks = _t(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.missing_lineage(scores, chunks, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def jn_02_lineage(spark, sf_dir):
    scores = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("score"))
    chunks = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return C.with_lineage(scores, chunks, "l_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def jn_06_evidence_in_chunk(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    chunks = lines.where("l_orderkey % 11 <> 0").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_linenumber").alias("page_start"), F.max("l_linenumber").alias("page_end"), F.collect_set("l_linenumber").alias("blocks"))
    chunks = chunks.withColumn("path", F.concat(F.lit("s"), (F.col("chunk_id") % 3).cast("string")))
    shift = F.when(F.col("l_partkey") % 13 == 0, F.lit(9)).otherwise(F.lit(0))
    evidence = lines.select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_linenumber").alias("page_start"), (F.col("l_linenumber") + shift).alias("page_end"), F.array((F.col("l_linenumber") + F.when(F.col("l_partkey") % 17 == 0, 20).otherwise(0)).cast("int")).alias("blocks"), F.when(F.col("l_partkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string"))).alias("path"))
    chunks = chunks.withColumn("blocks", F.col("blocks").cast("array<int>"))
    return C.in_its_chunk(evidence, chunks).groupBy("fault").agg(F.count("*").alias("n"))


def ret_12_best_match(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    m = lines.select((F.col("l_suppkey") % 20).cast("long").alias("query_id"), F.col("l_partkey").alias("chunk"), F.round(F.col("l_discount"), 2).alias("score"), F.col("l_linenumber").cast("long").alias("hop"), (F.col("l_quantity").cast("long") % 5).alias("rank"), F.col("l_suppkey").alias("seed_id"), F.col("l_orderkey").alias("evidence_id"))
    return C.best_match(m, "chunk")


def ret_15_candidate_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", C.candidate_id("chunk", F.col("lang"), F.col("source"), F.col("doc_id")).alias("chunk"), C.candidate_id("evidence", F.col("lang"), F.col("source"), F.col("doc_id")).alias("evidence"))


def ret_18_branches(spark, sf_dir):
    """The longest documents, the English ones of the least ids, nothing, a missing index, and all lines slowly: what the first two find is fused."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")

    def slowly(batches):
        for b in batches:
            time.sleep(120)
            yield b

    found = branches.run(
        spark,
        {
            "dense": lambda: d.orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id"),
            "sparse": lambda: d.where("lang = 'en'").orderBy("doc_id").limit(40).select("doc_id"),
            "graph": lambda: spark.read.parquet(f"{sf_dir}/no-such-index").select("doc_id"),
            "multimodal": lambda: _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).mapInPandas(slowly, "doc_id long"),
            "none": lambda: d.where("doc_id < 0").select("doc_id"),
        },
        d.select("doc_id").limit(0),
        {"dense": 300, "sparse": 300, "graph": 300, "multimodal": 4, "none": 300},
    )
    return branches.fused(found, "doc_id")


def lnk_02_parsed(spark, sf_dir):
    return E.parsed(_t(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, [f for f, _, _ in _OUTPUTS])), (F.col("doc_id") % len(_OUTPUTS) + 1).cast("int")).alias("output"))).select("doc_id", "category", F.size("parsed.entities").alias("n"))


_OUTPUT = '{"entities": [{"name": "A", "entity_type": "人物", "aliases": []}], "relations": [{"source": "A", "target": "B", "relation_type": "属于", "evidence": "A of B"}]}'
#: Outputs of a model, what they should be told to be, and how many entities they give.
_OUTPUTS = [
    (_OUTPUT, "ok", 1),
    (f"```json\n{_OUTPUT}\n```", "ok", 1),
    ("not json", "invalid_json", None),
    (_OUTPUT.replace("人物", "person"), "unknown_entity_type", None),
    (_OUTPUT.replace("属于", "of"), "unknown_relation_type", None),
    (_OUTPUT.replace('"relations"', '"links"'), "schema_validation", None),
    ("[1, 2]", "schema_validation", None),
    (_OUTPUT.replace('"A", "entity_type"', '" ", "entity_type"'), "schema_validation", None),
    (_OUTPUT.replace('"aliases": []', '"aliases": [], "x": 1'), "schema_validation", None),
    (_OUTPUT.replace('"aliases": []', '"aliases": "q"'), "schema_validation", None),
    (_OUTPUT.replace('"aliases": []', '"aliases": ["q", "Q "]'), "schema_validation", None),
    (_OUTPUT.replace('"aliases": []', '"aliases": ["q", 1]'), "schema_validation", None),
    (_OUTPUT.replace('"aliases": []', '"aliases": ["q", "r"]'), "ok", 1),
    (_OUTPUT.replace('"name": "A"', '"name": 7'), "schema_validation", None),
    (_OUTPUT.replace('"name": "A"', f'"name": "{"a" * 201}"'), "schema_validation", None),
    (_OUTPUT.replace(', "evidence": "A of B"', ""), "schema_validation", None),
    ('{"entities": null}', "schema_validation", None),
    ('{"entities": [3]}', "schema_validation", None),
    ("{}", "ok", 0),
]


def lnk_03_relations(spark, sf_dir):
    """Each nation's relation to its region with a fault by its number: see the SQL for which."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = F.col("n_nationkey") % 8
    land = F.concat("n_name", F.lit(" land"))
    lies = lambda *x: F.concat(*x)
    rows = n.select(
        F.col("r_name").alias("document_id"), F.col("n_nationkey").cast("long").alias("relation_no"), F.when(by == 4, land).otherwise(F.upper("n_name")).alias("source"),
        F.when(by == 0, F.lit("Atlantis")).when(by == 5, F.lit("realm")).otherwise(F.col("r_name")).alias("target"), F.lit("位于").alias("relation_type"),
        F.when(by == 1, F.lit("lies elsewhere")).when(by == 2, lies(F.lit("lies  in "), "r_name")).when(by == 3, lies("n_name", F.lit(" lies"))).otherwise(lies("n_name", F.lit(" LIES in "), "r_name")).alias("evidence"),
    )
    again = rows.where("relation_no % 8 = 6").withColumn("relation_no", F.col("relation_no") + 100)
    named = n.select(F.col("r_name").alias("document_id"), F.col("n_name").alias("entity_id"), F.initcap("n_name").alias("name"), F.array(land, F.lit("Realm")).alias("aliases"))
    regions = n.select(F.col("r_name").alias("document_id"), F.col("r_name").alias("entity_id"), F.col("r_name").alias("name"), F.array().cast("array<string>").alias("aliases")).distinct()
    texts = n.groupBy(F.col("r_name").alias("document_id")).agg(F.array_join(F.collect_list(F.concat("n_name", F.lit(" lies in "), "r_name")), ". ").alias("text"))
    return E.grounded_relations(rows.unionByName(again), named.unionByName(regions), texts).select("relation_no", "source_id", "status")


def cmp_02_facts(spark, sf_dir):
    """What is expected of each nation's suppliers (by its number: the first supplier's balance, a wrong balance, one row twice, no rows, nothing) against the suppliers."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("case_id"), F.col("s_suppkey").cast("long").alias("row"), "s_name", F.col("s_acctbal").cast("double").alias("b"))
    cell = lambda c, x, t: F.struct(F.lit(c).alias("column"), x.cast("double").alias("number"), t.cast("string").alias("string"))
    results = s.select("case_id", "row", F.inline(F.array(cell("name", F.lit(None), F.col("s_name")), cell("balance", F.col("b"), F.lit(None)))))
    first = s.groupBy("case_id").agg(F.min(F.struct("row", "s_name", "b")).alias("r"))
    cases = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("case_id")).join(first, "case_id", "left")
    by, name, balance = F.col("case_id") % 5, F.col("r.s_name"), F.col("r.b")
    fact = lambda i, *cells: F.transform(F.array(*cells), lambda c: F.struct(F.lit(i).alias("fact"), c["column"].alias("column"), c["number"].alias("number"), c["string"].alias("string")))
    one = fact(0, cell("name", F.lit(None), name), cell("balance", balance * (1 + 1e-9), F.lit(None)))
    none = F.array(F.struct(F.lit(0).alias("fact"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("string")))
    asked = F.when(by == 0, one).when(by == 1, fact(0, cell("name", F.lit(None), name), cell("balance", balance + 1, F.lit(None)))).when(by == 2, F.concat(one, fact(1, cell("name", F.lit(None), name)))).when(by == 3, none)
    facts = cases.where(asked.isNotNull()).select("case_id", F.inline(asked))
    return X.facts_hold(cases, facts, results)


def str_07_cells(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    md = F.concat(F.lit("| name | key |\n|:---|---:|\n| "), "n_name", F.lit("  x |"), F.col("n_nationkey").cast("string"), F.lit("|\n|  | |\nno cells\n| a\\|b | c |"))
    html = F.concat(F.lit("<table><tr><th>name</th></tr><TR class='x'><td><b>"), "n_name", F.lit("</b><br>y</td><td> "), F.col("n_nationkey").cast("string"), F.lit(" </td></TR><tr><td></td></tr></table>"))
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, "|")), ";")
    return n.select("n_nationkey", flat(E.markdown_cells(md)).alias("markdown"), flat(E.html_cells(html)).alias("html"))


def agg_09_deltas(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("delta", F.lit(1.0) / (1 + F.col("o_orderkey") % 5) - F.lit(1.0) / (1 + F.col("o_custkey") % 7))
    return X.deltas(o, ["o_orderstatus"], "delta", few=500)


def agg_11_contribution(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("key"), "o_orderpriority", "o_totalprice", "o_orderdate")
    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    vector, graph = rank(o, F.desc("o_totalprice"), "key"), rank(o.where("query_id % 9 <> 0"), F.desc("o_orderdate"), "key")
    return X.contribution(o.where("o_orderpriority = '1-URGENT' and key % 4 = 0"), vector, graph, rank(o, F.desc(F.col("o_totalprice") * (F.col("key") % 3)), "key"), "key", k=5)


def agg_24_corpus_audit(spark, sf_dir):
    key = lambda name, c, where="true": _t(spark, sf_dir, name).where(where).select(F.col(c).alias("key"))
    return X.corpus_audit({"customers": (key("customer", "c_custkey"), key("orders", "o_custkey")), "parts": (key("part", "p_partkey", "p_partkey % 6 <> 0"), key("part", "p_partkey", "p_partkey % 10 <> 0"))}, "key")


def aud_02_snapshot_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    before, after = o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 15 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return X.snapshot_diff(before, after, ["o_orderkey"])


def src_02_corpus(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null")
    manifest = d.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("sha"))
    files = d.where("doc_id % 13 <> 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("n"))
    return catalog.corpus(manifest, files)


def _built(spark, sf_dir, name, rows, contract, **checks):
    """A generation store of its own in the shared folder, with the rows as its first generation."""
    where = f"{shared_folder(spark)}/lorespark/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    store = L.Generations(spark, where)
    store.build(rows, contract)
    return store


def _vector_index(spark, sf_dir, name):
    """Vectors and their evidence as an index of many buckets, with the vectors."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("document_id"), "vec_id", F.col("embedding").alias("vector"))
    index = manifests.Index(spark, f"{shared_folder(spark)}/lorespark/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
    index.build({"vectors": v, "evidence": _evidence_of(v)}, {"v": 1}, bucket_rows=100)
    return index, v


def _evidence_of(v):
    return v.select("document_id", F.concat(F.lit("ev-"), F.col("vec_id").cast("string")).alias("evidence_id"))


def _unit_vectors(tables):
    if bad := vector_faults(tables["vectors"], "vec_id", "vector", 64).first():
        raise ValueError(f"{bad['vec_id']}: {bad['reason']}")


def _documents_of(index):
    n = index.read("evidence").groupBy("document_id").agg(F.count("*").alias("evidence"))
    return index.read("vectors").groupBy("document_id").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).join(n, "document_id", "full_outer")


def snk_04_replace_vectors(spark, sf_dir):
    """Two documents keep every third vector, one loses all."""
    index, v = _vector_index(spark, sf_dir, "vectors")
    new = v.where("document_id in ('1', '2') and vec_id % 3 = 0")
    index.replace({"vectors": new, "evidence": _evidence_of(new)}, {"v": 1}, ["1", "2"], check=_unit_vectors, unique={"vectors": "vec_id"})
    index.delete(["3"], {"v": 1})
    return _documents_of(index)


def snk_05_replace_refused(spark, sf_dir):
    """Vectors of another dimension, repeated and foreign ids, another contract and rows of other documents are refused, and all tables stay as they were."""
    index, v = _vector_index(spark, sf_dir, "representations")
    one, other, refused = v.where("document_id = '1'"), v.where("document_id = '2'"), 0
    zero = F.lit(0).cast(dict(v.dtypes)["vec_id"])
    for rows, contract in ((one.withColumn("vector", F.slice("vector", 1, 5)), {"v": 1}), (one.withColumn("vec_id", zero), {"v": 1}), (other.withColumn("document_id", F.lit("1")), {"v": 1}), (one, {"v": 2}), (other, {"v": 1})):
        try:
            index.replace({"vectors": rows, "evidence": _evidence_of(rows)}, contract, ["1"], check=_unit_vectors, unique={"vectors": "vec_id"})
        except ValueError:
            refused += 1
    return _documents_of(index).withColumn("refused", F.lit(refused).cast("long"))


def snk_03_generation_delete(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"))
    store = _built(spark, sf_dir, "deleted", d, {"v": 1})
    gone = [store.delete("src1", {"v": 1}), store.delete("src1", {"v": 1})]
    return store.read().groupBy("document_id").agg(F.count("*").alias("n")).withColumns({"first": F.lit(gone[0]).cast("long"), "again": F.lit(gone[1]).cast("long")})


def stream_frames(spark, sf_dir):
    """Conversations as answers: their turns are tokens, the roles citations; every ninth fails after its first turn."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.col("role").alias("text"))
    failures = c.where("query_id % 9 = 0").groupBy("query_id").agg(F.min("seq").alias("after")).withColumn("code", F.lit("provider"))
    return frames.answer_frames(c, c.where("query_id % 4 <> 0").select("query_id", F.col("text").alias("citation")), failures)


FUNCTIONS = (
    flt_01_scope, flt_01_scope_narrow, flt_07_text_present, flt_08_question_gates, jn_02_missing_lineage, jn_02_lineage, jn_06_evidence_in_chunk, ret_12_best_match, ret_15_candidate_ids, ret_18_branches, lnk_02_parsed,
    lnk_03_relations, cmp_02_facts, str_07_cells, agg_09_deltas, agg_11_contribution, agg_24_corpus_audit, aud_02_snapshot_diff, src_02_corpus, snk_03_generation_delete, snk_04_replace_vectors, snk_05_replace_refused, stream_frames,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_ID = "'{kind}_candidate_v1_' || sha256('{{\"document_id\":\"' || source || '\",\"kind\":\"{kind}\",\"knowledge_base_id\":\"' || lang || '\",\"local_id\":\"' || doc_id || '\",\"schema_version\":\"1.0\"}}')"
ORACLE = {
    "flt_01_scope": "SELECT doc_id, source AS document_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS modality FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 <> 0)",
    "flt_01_scope_narrow": "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3' AND doc_id % 3 = 0 AND doc_id % 4 <> 0",
    "flt_07_text_present": "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0 GROUP BY 1",
    "flt_08_question_gates": "WITH b AS (SELECT CAST(regexp_replace(CAST(item_id AS VARCHAR), '\\D', '', 'g') AS BIGINT) AS item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM benchmark), w AS (SELECT *, regexp_extract_all(lower(p), '[\\p{L}\\p{N}]+(?:[._-][\\p{L}\\p{N}]+)*') AS t FROM b) SELECT item_id, CASE item_id % 5 WHEN 1 THEN 'blank' WHEN 2 THEN 'too_short' WHEN 3 THEN 'no_letters' WHEN 4 THEN 'repetitive' ELSE CASE WHEN coalesce(length(p), 0) = 0 THEN 'blank' WHEN length(p) < 8 THEN 'too_short' WHEN length(p) > 400 THEN 'too_long' WHEN NOT regexp_matches(p, '\\p{L}') THEN 'no_letters' WHEN len(list_distinct(t)) * 4 < len(t) THEN 'repetitive' END END AS code FROM w",
    "jn_02_missing_lineage": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1",
    "jn_02_lineage": "SELECT o_orderstatus, count(*) AS n, sum(score) AS score FROM (SELECT l_orderkey, max(l_quantity) AS score FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "jn_06_evidence_in_chunk": "WITH c AS (SELECT l_orderkey AS k, min(l_linenumber) AS a, max(l_linenumber) AS z, list(DISTINCT l_linenumber) AS b, 's' || (l_orderkey % 3) AS p FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey), e AS (SELECT l_orderkey AS k, l_linenumber AS a, l_linenumber + CASE WHEN l_partkey % 13 = 0 THEN 9 ELSE 0 END AS z, l_linenumber + CASE WHEN l_partkey % 17 = 0 THEN 20 ELSE 0 END AS b, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 's' || (l_partkey % 3) END AS p FROM lineitem) SELECT CASE WHEN c.k IS NULL THEN 'absent' WHEN e.a < c.a OR e.z > c.z THEN 'page' WHEN NOT list_contains(c.b, e.b) THEN 'block' WHEN e.p <> '' AND e.p <> c.p THEN 'path' END AS fault, count(*) AS n FROM e LEFT JOIN c ON c.k = e.k GROUP BY 1",
    "ret_12_best_match": "SELECT query_id, chunk, score, hop, rank, seed_id, evidence_id FROM (SELECT CAST(l_suppkey % 20 AS BIGINT) AS query_id, l_partkey AS chunk, round(l_discount, 2) AS score, CAST(l_linenumber AS BIGINT) AS hop, CAST(trunc(l_quantity) AS BIGINT) % 5 AS rank, l_suppkey AS seed_id, l_orderkey AS evidence_id FROM lineitem) QUALIFY row_number() OVER (PARTITION BY query_id, chunk ORDER BY score DESC, hop, rank, seed_id, evidence_id) = 1",
    "ret_15_candidate_ids": f"SELECT doc_id, {_ID.format(kind='chunk')} AS chunk, {_ID.format(kind='evidence')} AS evidence FROM documents",
    "ret_18_branches": "WITH b AS (SELECT doc_id, 'dense' AS b FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40) UNION ALL SELECT doc_id, 'sparse' FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40)) SELECT doc_id, string_agg(b, ',' ORDER BY b) AS branches, 'graph' AS failed, 'multimodal' AS late FROM b GROUP BY 1",
    "lnk_02_parsed": f"SELECT doc_id, [{', '.join(repr(c) for _, c, _ in _OUTPUTS)}][doc_id % {len(_OUTPUTS)} + 1] AS category, [{', '.join('NULL' if n is None else str(n) for _, _, n in _OUTPUTS)}][doc_id % {len(_OUTPUTS)} + 1] AS n FROM documents",
    "lnk_03_relations": "WITH k AS (SELECT n_nationkey AS k, n_name AS s FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey % 8 = 6) SELECT CAST(k AS BIGINT) AS relation_no, s AS source_id, CASE WHEN k >= 100 THEN 'duplicate' ELSE ['endpoint', 'evidence', 'source', 'target', 'ground', 'endpoint', 'ground', 'ground'][k % 8 + 1] END AS status FROM k",
    "cmp_02_facts": "WITH c AS (SELECT n_nationkey AS k, count(s_suppkey) AS n, count(DISTINCT s_name) AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT CAST(k AS BIGINT) AS case_id, CASE k % 5 WHEN 0 THEN n > 0 WHEN 1 THEN false WHEN 2 THEN n > 0 AND names < n WHEN 3 THEN n = 0 END AS holds FROM c",
    "str_07_cells": "SELECT n_nationkey, 'name|key;' || n_name || ' x|' || n_nationkey || ';a|b|c' AS markdown, 'name;' || n_name || ' y|' || n_nationkey AS html FROM nation",
    "agg_09_deltas": "WITH d AS (SELECT o_orderstatus, 1.0::DOUBLE / (1 + o_orderkey % 5) - 1.0::DOUBLE / (1 + o_custkey % 7) AS d FROM orders), g AS (SELECT o_orderstatus, list(d ORDER BY d) AS v, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_positive, count(*) FILTER (WHERE d = 0) AS n_zero, count(*) FILTER (WHERE d < 0) AS n_negative, round(avg(d), 8) AS mean, round(min(d), 8) AS least, round(max(d), 8) AS most FROM d GROUP BY 1) SELECT o_orderstatus, n, n_positive, n_zero, n_negative, mean, least, most, round(v[CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1], 8) AS p50, round(v[CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1], 8) AS p95 FROM g",
    "agg_11_contribution": "WITH o AS (SELECT o_custkey % 50 AS q, o_orderkey AS k, o_orderpriority AS p, o_totalprice AS t, o_orderdate AS d FROM orders), v AS (SELECT q, k FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY t DESC, k) <= 5), g AS (SELECT q, k FROM o WHERE q % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY d DESC, k) <= 5), h AS (SELECT q, k FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY t * (k % 3) DESC, k) <= 5), gold AS (SELECT DISTINCT q, k FROM o WHERE p = '1-URGENT' AND k % 4 = 0), m AS (SELECT gold.q, v.k IS NOT NULL AS v, g.k IS NOT NULL AS g, h.k IS NOT NULL AS h FROM gold LEFT JOIN v ON v.q = gold.q AND v.k = gold.k LEFT JOIN g ON g.q = gold.q AND g.k = gold.k LEFT JOIN h ON h.q = gold.q AND h.k = gold.k), p AS (SELECT q, bool_or(v) AS v, bool_or(g) AS g, bool_or(h) AS h, count(*) FILTER (WHERE g AND NOT v) AS r, count(*) FILTER (WHERE g AND NOT v AND h) AS f FROM m GROUP BY q) SELECT count(*) AS n_queries, count(*) FILTER (WHERE v) AS n_vector, count(*) FILTER (WHERE g) AS n_graph, count(*) FILTER (WHERE v AND g) AS n_both, count(*) FILTER (WHERE q NOT IN (SELECT q FROM g)) AS n_graph_empty, CAST(coalesce(sum(r), 0) AS BIGINT) AS n_recovered, CAST(coalesce(sum(f), 0) AS BIGINT) AS n_final_recovered, count(*) FILTER (WHERE h AND NOT v) AS n_improved, count(*) FILTER (WHERE v AND NOT h) AS n_regressed, count(*) FILTER (WHERE v = h) AS n_unchanged FROM p",
    "agg_24_corpus_audit": "WITH a AS (SELECT 'customers' AS part, c_custkey AS k, 1 AS e, 0 AS s FROM customer UNION ALL SELECT 'customers', o_custkey, 0, 1 FROM orders UNION ALL SELECT 'parts', p_partkey, 1, 0 FROM part WHERE p_partkey % 6 <> 0 UNION ALL SELECT 'parts', p_partkey, 0, 1 FROM part WHERE p_partkey % 10 <> 0), g AS (SELECT part, k, sum(e) AS e, sum(s) AS s FROM a GROUP BY 1, 2) SELECT part, count(*) FILTER (WHERE e > 0) AS n_expected, count(*) FILTER (WHERE s > 0) AS n_stored, count(*) FILTER (WHERE e > 0 AND s = 0) AS n_missing, count(*) FILTER (WHERE s > 0 AND e = 0) AS n_unexpected, count(*) FILTER (WHERE s > 1) AS n_repeated FROM g GROUP BY 1",
    "aud_02_snapshot_diff": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 15 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 10 = 0) <> (o_orderkey % 15 = 0) OR (o_orderkey % 10 <> 0 AND o_orderkey % 15 <> 0 AND o_orderkey % 7 = 0)",
    "src_02_corpus": "WITH m AS (SELECT doc_id, md5(text) AS sha, length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT sha, min(doc_id) AS document_id, count(*) AS n_copies FROM m GROUP BY 1) SELECT r.document_id, 'f' || r.document_id AS path, r.sha, r.n_copies, CASE WHEN r.document_id % 13 <> 0 THEN m.n END AS n, r.document_id % 13 <> 0 AS present FROM r JOIN m ON m.doc_id = r.document_id",
    "snk_03_generation_delete": "SELECT source AS document_id, count(*) AS n, (SELECT count(*) FROM documents WHERE source = 'src1') AS first, CAST(0 AS BIGINT) AS again FROM documents WHERE source <> 'src1' GROUP BY 1",
    "snk_04_replace_vectors": "SELECT CAST(label AS VARCHAR) AS document_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, count(*) AS evidence FROM embeddings WHERE label <> 3 AND (label NOT IN (1, 2) OR vec_id % 3 = 0) GROUP BY 1",
    "snk_05_replace_refused": "SELECT CAST(label AS VARCHAR) AS document_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, count(*) AS evidence, CAST(5 AS BIGINT) AS refused FROM embeddings GROUP BY 1",
    "stream_frames": """WITH c AS (SELECT conv_id AS q, CAST(turn AS BIGINT) AS t, role, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations), l AS (SELECT q, max(t) AS l, count(*) AS n, list_sort(list(DISTINCT role)) AS r FROM c GROUP BY 1),
        x AS (SELECT q, t AS seq, 'answer_delta' AS e, '{"text":"' || role || '"}' AS d FROM c WHERE q % 9 <> 0 OR t <= f UNION ALL SELECT q, l + 1, 'citations', CASE WHEN q % 4 = 0 THEN '{"citations":[]}' ELSE '{"citations":["' || array_to_string(r, '","') || '"]}' END FROM l WHERE q % 9 <> 0
        UNION ALL SELECT q, l + 2, 'complete', '{"n":' || n || '}' FROM l WHERE q % 9 <> 0 UNION ALL SELECT DISTINCT q, f + 1, 'error', '{"code":"provider"}' FROM c WHERE q % 9 = 0)
        SELECT q AS query_id, seq, 'event: ' || e || chr(10) || 'data: ' || d || chr(10) || chr(10) AS frame FROM x""",
}
