"""Blocks, sections, chunks, evidence and audits over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.scratch import cut
from lorespark.operators import blocks as B
from lorespark.sources.tables import table


def _blocks(spark, sf_dir):
    return B.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"))


def _short(df, *names):
    return df.withColumns({n: F.md5(n) for n in names})


def src_07_blocks(spark, sf_dir):
    return _short(_blocks(spark, sf_dir), "text")


def src_07_html_blocks(spark, sf_dir):
    return _short(B.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html", F.lit("web")), "text")


def blk_01_render(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("document_id", "block_id", F.md5(B.rendered(b)).alias("shown"))


def blk_03_sections(spark, sf_dir):
    return B.sectioned(_blocks(spark, sf_dir)).select("document_id", "block_id", "section")


def blk_03_section_paths(spark, sf_dir):
    p = B.section_paths(B.sectioned(_blocks(spark, sf_dir)))
    return p.select("document_id", "section", F.array_join("path", " / ").alias("path"), "n_blocks", "title_only")


def blk_05_chunks(spark, sf_dir):
    c = B.chunked(B.sectioned(_blocks(spark, sf_dir)))
    return c.select("document_id", "ordinal", "section", F.length("text").alias("n_chars"), F.size("block_ids").alias("n_blocks"), "page_start", "page_end", "chunk_id")


def blk_08_lineage(spark, sf_dir):
    """Faults planted in the real chunks, by the document's number: unknown blocks, missing chunks, a page more, a type more, blocks turned round, another
    path, and a block of the first section."""
    b = _blocks(spark, sf_dir)
    s = cut(B.sectioned(b.withColumn("text", F.when(F.col("type") == "title", F.col("text")))))  # without the texts that only chunks need
    number = F.col("document_id").cast("long")
    by = lambda k: number % 20 == k
    chunks = B.chunked(B.sectioned(b)).join(B.section_paths(s).select("kb_id", "document_id", "section", "path"), ["kb_id", "document_id", "section"])
    other = by(4) & (F.col("section") > 0)
    ids = F.when(by(2), F.reverse("block_ids")).when(other, F.concat(F.array(F.lit("b0")), "block_ids")).otherwise(F.col("block_ids"))
    chunks = chunks.withColumns(
        {
            "block_ids": ids,
            "page_start": F.when(other, 1).otherwise(F.col("page_start")),
            "page_end": F.col("page_end") + by(0).cast("long"),
            "content_types": F.when(by(1), F.array_append("content_types", F.lit("image"))).otherwise(F.col("content_types")),
            "path": F.when(by(3), F.array_append("path", F.lit("zz"))).otherwise(F.col("path")),
        }
    )
    return B.lineage_faults(chunks.where(number % 30 != 0), s.where(number % 50 != 0))


def _sections_as_chunks(spark, sf_dir):
    s = B.sectioned(_blocks(spark, sf_dir))
    rows = s.groupBy("kb_id", "document_id", "section").agg(F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "block_id", "text"))).alias("b"))
    return rows.select("kb_id", "document_id", F.col("section").alias("ordinal"), F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.transform("b", lambda x: x["block_id"]).alias("block_ids"))


def blk_09_profile(spark, sf_dir):
    return B.profile(_sections_as_chunks(spark, sf_dir)).select("chunks", "documents", "mean_blocks", F.col("shortest").cast("long"), F.col("longest").cast("long"), "p50", "p90", "oversized", "atomic", "split_texts")


def blk_10_evidence(spark, sf_dir):
    e = B.evidence(_blocks(spark, sf_dir))
    return e.select("document_id", "block_id", "page_number", "modality", "source_fingerprint", "evidence_id")


def blk_11_context(spark, sf_dir):
    return _short(B.context(_blocks(spark, sf_dir)), "context")


def blk_12_coverage(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    e = B.evidence(b)
    both = b.select("document_id", "block_id").join(e.where("modality <> 'table'").select("document_id", "block_id", "evidence_id"), ["document_id", "block_id"], "full_outer")
    return both.agg(F.count("*").alias("blocks"), F.count_if(F.col("evidence_id").isNull()).alias("missing"), F.countDistinct("evidence_id").alias("evidences"))


def blk_13_representations(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    r = B.representations(B.evidence(b), B.context(b)).where("searchable")
    return r.groupBy("modality", "representation_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.countDistinct("evidence_id").alias("evidences"))


def agg_28_coverage_buckets(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    r = B.representations(B.evidence(b), B.context(b))
    stored = r.where(F.substring("block_id", 2, 9).cast("int") % 7 != 0)
    keys = ["document_id", "block_id", "representation_type"]
    both = r.select(*keys, "modality", F.lit(1).alias("e")).join(stored.select(*keys, F.lit(1).alias("s")), keys, "left")
    return both.groupBy("modality", "representation_type").agg(F.count("*").alias("expected"), F.count("s").alias("matched"), F.count_if(F.col("s").isNull()).alias("missing"))


def blk_14_carrier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return docs.select("doc_id", F.md5(B.carrier(text, F.array("lang", "source"), F.array(F.lit("text"), F.lit("table")))).alias("carrier"))


def blk_15_points(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


def blk_16_subject(spark, sf_dir):
    rules = {"org": (".example.org",), "commercial": (".example.com", "shop"), "spam": ("casino", "pills", "spam")}
    return table(spark, sf_dir, "pages").select("page_id", B.subject(F.col("url"), rules).alias("subject"))


def flt_03_word_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.contains_word(F.col("text"), F.lit("The"))).select("doc_id")


def str_01_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.label(F.concat(F.upper("p_name"), F.lit("  "), F.col("p_brand"))).alias("label"))


def str_02_squeezed(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.squeezed(F.col("text"))).alias("squeezed"))


def str_03_ngrams(spark, sf_dir):
    g = T.character_ngrams(T.squeezed(F.col("text")), 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(g).cast("long").alias("n"))


def str_03_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.character_ngrams(T.squeezed(F.col("text")), 3).alias("g"))
    c = b.select((F.col("item_id") + 1).alias("item_id"), F.col("g").alias("h"))
    return b.join(c, "item_id").select("item_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


def str_04_occurs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(T.occurs(F.col("text"), F.lit("of the"))).select("doc_id")


def str_05_types(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    made = F.array(F.concat(F.lit(" Character  VARYING("), n, F.lit(")")), F.concat(F.lit("numeric("), n, F.lit(" , 2)")), F.lit("TIMESTAMP with  time zone"), F.concat(F.lit("time("), n, F.lit(") WITHOUT time zone")), F.lit("time without time zone"), F.lit("   "), F.lit("in\u0001t"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.clean_type(F.element_at(made, (F.col("n_nationkey") % 7 + 1).cast("int"))).alias("clean"))


def str_06_comment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.clean_comment(F.col("text"))).cast("long").alias("n"))


def id_01_identity(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.identity("entity", {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")}).alias("id"))


def id_02_pair_identity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a <> b").select("a", "b", T.pair_identity("link_pair", F.col("a"), F.col("b")).alias("id"))


FUNCTIONS = (
    src_07_blocks, src_07_html_blocks, blk_01_render, blk_03_sections, blk_03_section_paths, blk_05_chunks, blk_08_lineage, blk_09_profile, blk_10_evidence, blk_11_context, blk_12_coverage, blk_13_representations,
    agg_28_coverage_buckets, blk_14_carrier, blk_15_points, blk_16_subject, flt_03_word_filter, str_01_label, str_02_squeezed, str_03_ngrams, str_03_jaccard, str_04_occurs, str_05_types, str_06_comment, id_01_identity, id_02_pair_identity,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_B = """l AS (SELECT lang AS kb_id, CAST(doc_id AS VARCHAR) AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
p AS (SELECT kb_id, document_id, unnest(ls) AS text, unnest(range(len(ls))) AS pos FROM l),
b AS (SELECT kb_id, document_id, CAST(floor(pos / 20) + 1 AS BIGINT) AS page_number, pos % 20 AS reading_order, 'b' || pos AS block_id, CASE WHEN contains(text, ' | ') THEN 'table' WHEN length(text) <= 30 THEN 'title' ELSE 'text' END AS type, text, pos FROM p)"""
_S = """x AS (SELECT *, type = 'title' AND NOT coalesce(lag(type = 'title') OVER (PARTITION BY document_id ORDER BY pos), true) AS begins FROM b),
s AS (SELECT *, CAST(sum(CAST(begins AS INT)) OVER (PARTITION BY document_id ORDER BY pos) AS BIGINT) AS section FROM x)"""
_SHOWN = "CASE WHEN type = 'title' THEN '## ' || text ELSE text END"
_CHUNKS = f"""un AS (SELECT *, {_SHOWN} AS whole, count(*) FILTER (WHERE type <> 'title') OVER (PARTITION BY document_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unit FROM s),
q AS (SELECT document_id, section, unit, pos, page_number, type, whole AS rest, -1 AS piece, '' AS shown FROM un
    UNION ALL SELECT document_id, section, unit, pos, page_number, type, substr(rest, n + 1), piece + 1, substr(rest, 1, n) FROM (SELECT *, CASE WHEN type <> 'text' OR length(rest) <= 1600 THEN length(rest)
    WHEN regexp_matches(substr(rest, 1, 1600), '[。！？!?；;：:]') THEN length(regexp_extract(substr(rest, 1, 1600), '(?s)^.*[。！？!?；;：:]')) WHEN regexp_matches(substr(rest, 1, 1600), '\\s') THEN length(regexp_extract(substr(rest, 1, 1600), '(?s)^.*\\s')) ELSE 1600 END AS n FROM q WHERE rest <> '')),
pc AS (SELECT * FROM q WHERE piece >= 0),
us AS (SELECT document_id, section, unit, piece, sum(length(shown)) + 2 * (count(*) - 1) AS size, row_number() OVER (PARTITION BY document_id, section ORDER BY unit, piece) - 1 AS i FROM pc GROUP BY document_id, section, unit, piece),
gr AS (SELECT document_id, section, i, 0 AS part, size AS now FROM us WHERE i = 0
    UNION ALL SELECT us.document_id, us.section, us.i, part + CAST(now >= 1200 OR now + 2 + size > 1600 AS INT), CASE WHEN now >= 1200 OR now + 2 + size > 1600 THEN size ELSE now + 2 + size END FROM gr JOIN us ON us.document_id = gr.document_id AND us.section = gr.section AND us.i = gr.i + 1),
pl AS (SELECT pc.*, gr.part FROM pc JOIN us USING (document_id, section, unit, piece) JOIN gr USING (document_id, section, i)),
ck AS (SELECT document_id, section, part, sum(length(shown)) + 2 * (count(*) - 1) AS size, min(pos) AS a, max(pos) AS z FROM pl GROUP BY document_id, section, part),
mg AS (SELECT *, lead(part) OVER w IS NULL AND size < 240 AND lag(size) OVER w + 2 + size <= 1600 AND lag(z) OVER w < a AS joins FROM ck WINDOW w AS (PARTITION BY document_id, section ORDER BY part)),
fin AS (SELECT document_id, section, part - CAST(coalesce(joins, false) AS INT) AS part, shown, pos, page_number FROM pl JOIN mg USING (document_id, section, part)),
ch AS (SELECT document_id, section, part, sum(length(shown)) + 2 * (count(*) - 1) AS n_chars, count(DISTINCT pos) AS n_blocks, min(page_number) AS page_start, max(page_number) AS page_end, list_sort(list(DISTINCT pos)) AS ps FROM fin GROUP BY document_id, section, part),
chunk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section, part) - 1 AS ordinal FROM ch)"""
_EID = """'evidence_v2_' || sha256('{"identity_schema_version":"2.0","kind":"evidence","payload":{"block_id":"' || block_id || '","document_id":"' || document_id || '","kb_id":"' || kb_id || '"}}')"""
_C = """c0 AS (SELECT *, list(substr(text, 1, 160)) FILTER (WHERE type = 'title') OVER (PARTITION BY document_id, page_number ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS path,
    substr(lag(text) OVER w, 1, 480) AS before, substr(lead(text) OVER w, 1, 480) AS after FROM b WINDOW w AS (PARTITION BY document_id, page_number ORDER BY reading_order)),
c1 AS (SELECT *, coalesce(array_to_string(list_slice(path, greatest(len(path) - 3, 1), len(path)), ' / '), '') AS p1, concat_ws(' ', before, after) AS n1 FROM c0),
c AS (SELECT *, substr(concat_ws('; ', CASE WHEN p1 <> '' THEN '章节: ' || p1 END, CASE WHEN type <> 'title' AND n1 <> '' THEN '邻近文本: ' || n1 END), 1, 1200) AS context FROM c1)"""
_M = "CASE type WHEN 'table' THEN 'table' ELSE 'text' END"
_R = f"""r AS (SELECT document_id, block_id, {_M} AS modality, CASE type WHEN 'table' THEN 'markdown' ELSE 'text' END AS representation_type, {_SHOWN} AS content FROM c
    UNION ALL SELECT document_id, block_id, {_M}, 'context', context FROM c WHERE context <> '')"""
_SQ = "regexp_replace(lower(text), '\\s+', '', 'g')"
_NG = f"list_distinct(list_transform(range(1, greatest(length({_SQ}) - 1, 2)), lambda i: substr({_SQ}, i, 3)))"
ORACLE = {
    "blk_05_chunks": f"""WITH RECURSIVE {_B}, {_S}, {_CHUNKS} SELECT document_id, ordinal, section, CAST(n_chars AS BIGINT) AS n_chars, n_blocks, page_start, page_end,
        'chunk_v2_' || sha256('{{"identity_schema_version":"2.0","kind":"chunk","payload":{{"blocks":["' || array_to_string(list_transform(ps, lambda x: 'b' || x), '","') || '"],"document_id":"' || document_id || '","ordinal":' || ordinal || '}}}}') AS chunk_id FROM chunk""",
    "blk_08_lineage": f"WITH RECURSIVE {_B}, {_S}, {_CHUNKS}, d AS (SELECT CAST(document_id AS BIGINT) AS d FROM b), k AS (SELECT CAST(document_id AS BIGINT) AS d, section, n_blocks FROM chunk) SELECT 'unknown_block' AS code, count(*) AS n FROM d WHERE d % 50 = 0 AND d % 30 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'uncovered_block', count(*) FROM d WHERE d % 30 = 0 AND d % 50 <> 0 HAVING count(*) > 0 UNION ALL SELECT code, count(*) FROM (SELECT CASE d % 20 WHEN 0 THEN 'page_range' WHEN 1 THEN 'types' WHEN 2 THEN CASE WHEN n_blocks > 1 THEN 'order' END WHEN 3 THEN 'path' WHEN 4 THEN CASE WHEN section > 0 THEN 'section' END END AS code FROM k WHERE d % 30 <> 0 AND d % 50 <> 0) WHERE code IS NOT NULL GROUP BY 1",
    "src_07_blocks": f"WITH {_B} SELECT kb_id, document_id, page_number, reading_order, block_id, type, md5(text) AS text FROM b",
    "blk_01_render": f"WITH {_B} SELECT document_id, block_id, md5({_SHOWN}) AS shown FROM b",
    "blk_03_sections": f"WITH {_B}, {_S} SELECT document_id, block_id, section FROM s",
    "blk_03_section_paths": f"WITH {_B}, {_S} SELECT document_id, section, coalesce(string_agg(text, ' / ' ORDER BY pos) FILTER (WHERE type = 'title'), '') AS path, count(*) AS n_blocks, count(*) = count(*) FILTER (WHERE type = 'title') AS title_only FROM s GROUP BY 1, 2",
    "blk_09_profile": f"""WITH {_B}, {_S}, k AS (SELECT document_id, section, length(string_agg(text, chr(10) ORDER BY pos)) AS n, count(*) AS b FROM s GROUP BY 1, 2)
        SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, round(avg(b), 6) AS mean_blocks, min(n) AS shortest, max(n) AS longest, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90,
        count(*) FILTER (WHERE n > 1600) AS oversized, count(*) FILTER (WHERE b = 1) AS atomic, CAST(0 AS BIGINT) AS split_texts FROM k""",
    "blk_10_evidence": f"WITH {_B} SELECT document_id, block_id, page_number, {_M} AS modality, sha256({_SHOWN}) AS source_fingerprint, {_EID} AS evidence_id FROM b",
    "blk_11_context": f"WITH {_B}, {_C} SELECT kb_id, document_id, block_id, md5(context) AS context FROM c",
    "blk_12_coverage": f"WITH {_B} SELECT count(*) AS blocks, count(*) FILTER (WHERE type = 'table') AS missing, count(DISTINCT CASE WHEN type <> 'table' THEN {_EID} END) AS evidences FROM b",
    "blk_13_representations": f"WITH {_B}, {_C}, {_R} SELECT modality, representation_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT document_id || block_id) AS evidences FROM r GROUP BY 1, 2",
    "agg_28_coverage_buckets": f"WITH {_B}, {_C}, {_R}, k AS (SELECT *, CAST(block_id[2:] AS INT) % 7 = 0 AS gone FROM r) SELECT modality, representation_type, count(*) AS expected, count(*) FILTER (WHERE NOT gone) AS matched, count(*) FILTER (WHERE gone) AS missing FROM k GROUP BY 1, 2",
    "blk_15_points": "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h",
    "blk_14_carrier": "SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 AND trim(text) <> '' THEN text ELSE lang || ' / ' || source || ' [text, table]' END) AS carrier FROM documents",
    "blk_16_subject": "SELECT page_id, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN a THEN 'org' WHEN b THEN 'commercial' ELSE 'spam' END AS subject FROM (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS n FROM (SELECT page_id, contains(url, '.example.org') AS a, contains(url, '.example.com') OR contains(url, 'shop') AS b, contains(url, 'casino') OR contains(url, 'pills') OR contains(url, 'spam') AS c FROM pages))",
    "flt_03_word_filter": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])The([^A-Za-z0-9_]|$)')",
    "str_01_label": "SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS label FROM part",
    "str_02_squeezed": f"SELECT item_id, md5({_SQ}) AS squeezed FROM benchmark",
    "str_03_ngrams": f"SELECT item_id, CAST(len({_NG}) AS BIGINT) AS n FROM benchmark",
    "str_03_jaccard": f"WITH g AS (SELECT item_id, {_NG} AS g FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.item_id = b.item_id + 1",
    "str_04_occurs": r"SELECT doc_id FROM documents WHERE contains(text, 'of the') OR contains(regexp_replace(text, '[^\w]+', '', 'g'), 'ofthe')",
    "str_05_types": "SELECT n_nationkey, ['varchar(' || n_nationkey || ')', 'numeric(' || n_nationkey || ',2)', 'timestamptz', 'time(' || n_nationkey || ') without time zone', 'time', NULL, NULL][n_nationkey % 7 + 1] AS clean FROM nation",
    "str_06_comment": r"SELECT doc_id, CAST(length(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'), ' '), 1, 1000)) AS BIGINT) AS n FROM documents",
    "id_01_identity": """SELECT c_custkey, 'entity_v2_' || sha256('{"identity_schema_version":"2.0","kind":"entity","payload":{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}}') AS id FROM customer""",
    "id_02_pair_identity": """SELECT a.n_name AS a, b.n_name AS b, 'link_pair_v2_' || sha256('{"identity_schema_version":"2.0","kind":"link_pair","payload":{"first":"' || least(a.n_name, b.n_name) || '","second":"' || greatest(a.n_name, b.n_name) || '"}}') AS id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name""",
}
