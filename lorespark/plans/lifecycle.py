"""Index lifecycle, catalog, gated statements and streams over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import lifecycle as L
from lorespark.operators import sqlgate
from lorespark.sources import catalog
from lorespark.sources.tables import NAMES, table
from lorespark.streaming import usage


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content"))


def snk_02_replace(spark, sf_dir):
    now = _chunks(spark, sf_dir)
    new = now.where("document_id = 'src3' and chunk_id % 3 = 0").withColumn("content", F.lit("new"))
    return L.replaced(now, new, "document_id").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("content") == "new").alias("n_new"))


def snk_03_delete(spark, sf_dir):
    gone = spark.createDataFrame([("src1",), ("src5",)], "document_id string")
    return _chunks(spark, sf_dir).join(gone, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("n"))


def snk_06_quarantine(spark, sf_dir):
    index = _chunks(spark, sf_dir).withColumn("quarantined", F.col("chunk_id") % 17 == 0)
    on = L.quarantined(index, index.where("chunk_id % 10 = 3"), "chunk_id")
    back = L.quarantined(on, on.where("chunk_id % 34 = 0"), "chunk_id", False)
    return back.groupBy("quarantined").agg(F.count("*").alias("n"))


def snk_09_memberships(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_custkey").alias("local_entity_id"), (F.col("o_custkey") % 10).alias("canonical_entity_id"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("decision_id"))
    m = L.memberships(links)
    return m.select("local_entity_id", "canonical_entity_id", F.size("decision_ids").cast("long").alias("n"), "primary_decision")


def snk_09_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("local_entity_id"), F.col("o_orderstatus").alias("canonical_entity_id"))
    return L.membership_conflicts(o)


def src_09_catalog(spark, sf_dir):
    cols = catalog.columns(spark, {n: table(spark, sf_dir, n) for n in NAMES if n not in ("embeddings",)})
    return cols.select("relation", "ordinal", "name")


def src_10_snapshot(spark, sf_dir):
    cols = catalog.columns(spark, {n: table(spark, sf_dir, n) for n in NAMES})
    keys = spark.createDataFrame([("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_wrong", "nation", "n_nationkey")], "source string, column string, target string, target_column string")
    return catalog.snapshot(cols, keys, ["orders", "customer", "lineitem"]).select("source", "column", "target", "target_column")


def src_11_metadata_scan(spark, sf_dir):
    """Labels of vectors without reading the vectors."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def src_01_faults(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("title", "text", "table", "formula", "image", "video")]), (F.col("doc_id") % 6 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 4 != 0, F.substring("text", 1, 5))
    b = d.select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("block_id"), kind.alias("type"), body.alias("text"), F.when(F.col("doc_id") % 4 == 1, "a").alias("markdown"), F.when(F.col("doc_id") % 8 == 1, "b").alias("html"), F.lit(None).cast("string").alias("latex"), F.when(F.col("doc_id") % 5 == 0, "x").alias("asset_ref"))
    return catalog.faults(b).groupBy("reason").agg(F.count("*").alias("n"))


def gate_statement(spark, sf_dir):
    """A question's statement through the gate, its bounded rows as a table."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    policy = sqlgate.Policy(frozenset(tables), max_rows=15)
    sql = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY balance DESC, n_name LIMIT 100"
    r = sqlgate.execute(spark, sql, policy, tables)
    return spark.createDataFrame([tuple(x) for x in r.rows], "n_name string, customers long, balance double")


def agg_22_stream_plan(spark, sf_dir):
    return usage.buckets(table(spark, sf_dir, "events"), 60)


FUNCTIONS = (snk_02_replace, snk_03_delete, snk_06_quarantine, snk_09_memberships, snk_09_conflicts, src_01_faults, src_09_catalog, src_10_snapshot, src_11_metadata_scan, gate_statement, agg_22_stream_plan)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLE = {
    "snk_02_replace": "SELECT source AS document_id, count(*) AS n, count(*) FILTER (WHERE source = 'src3') AS n_new FROM documents WHERE source <> 'src3' OR doc_id % 3 = 0 GROUP BY 1",
    "snk_03_delete": "SELECT source AS document_id, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src5') GROUP BY 1",
    "snk_06_quarantine": "SELECT (doc_id % 17 = 0 OR doc_id % 10 = 3) AND doc_id % 34 <> 0 AS quarantined, count(*) AS n FROM documents GROUP BY 1",
    "snk_09_memberships": "SELECT o_custkey AS local_entity_id, o_custkey % 10 AS canonical_entity_id, count(DISTINCT o_orderkey) AS n, min(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS primary_decision FROM orders GROUP BY 1, 2",
    "snk_09_conflicts": "SELECT o_custkey AS local_entity_id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "src_01_faults": "WITH b AS (SELECT doc_id, ['title', 'text', 'table', 'formula', 'image', 'video'][doc_id % 6 + 1] AS type, CASE WHEN doc_id % 4 <> 0 THEN nullif(substr(text, 1, 5), '') END AS text, doc_id % 4 = 1 AS md, doc_id % 8 = 1 AS ht, doc_id % 5 = 0 AS asset FROM documents), r AS (SELECT CASE WHEN type = 'video' THEN 'type' WHEN type IN ('title', 'text') AND text IS NULL THEN 'text' WHEN type = 'table' AND md AND ht THEN 'two_bodies' WHEN type = 'table' AND NOT md AND NOT ht AND NOT asset THEN 'no_body' WHEN type = 'formula' THEN 'latex' WHEN type = 'image' AND NOT asset THEN 'asset' END AS reason FROM b) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "src_10_snapshot": "SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'c_custkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey')) v(source, \"column\", target, target_column)",
    "src_11_metadata_scan": "SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1",
    "src_09_catalog": "SELECT table_name AS relation, ordinal_position AS ordinal, column_name AS name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'pages', 'benchmark', 'labels', 'conversations')",
    "gate_statement": "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY balance DESC, n_name LIMIT 15",
    "agg_22_stream_plan": "SELECT time_bucket(INTERVAL '60 minutes', ts) AS bucket, count(*) AS attempts, round(sum(value), 4) AS value FROM events WHERE event_type = 'error' GROUP BY 1",
}
