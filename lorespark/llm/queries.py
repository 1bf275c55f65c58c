"""The queries of the numbered operators over the test tables, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, counts, decontaminate, jaccard, minhash, periodic, pii, secrets, simhash, suffixtree, toxicity, urls
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)
    return found.select("doc_id", "n_words", "n_hit", "longest", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.lorespark.pii.key", "a key for the synthetic tables, no secret")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_edits(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(alignment.align(table(spark, sf_dir, "documents"), a, b))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.detect(periodic.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))))


_ALL = (op1_bpe, op2_minhash, op3_suffix_tree, op4_decontaminate, op5_pii, op6_urls, op7_token_counts, op8_simhash, op9_secrets, op10_toxicity, op11_alignment, op12_jaccard, op13_periodic)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOC_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+')"
_ITEM_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

def _linked(k: int, percent: int, more: str) -> str:
    """SQL of components of documents whose sets of k-word shingles have percent of their union in common."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle})) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}
    GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= {percent} * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id{more}
FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = sets.doc_id
"""


_OP4 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
spots AS (SELECT item, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS q FROM items WHERE len(w) > 0),
wins AS (SELECT item, size, q, array_to_string(w[q:q + size - 1], ' ') AS x FROM spots),
docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
starts AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, w FROM docs, sizes WHERE len(w) >= size),
grams AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS x FROM starts),
hits AS (SELECT g.doc_id, g.size, g.p, i.item, i.q FROM grams g JOIN wins i ON i.x = g.x AND i.size = g.size),
words AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS spot FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) + any_value(size) - 1 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, p - q ORDER BY p) AS island FROM hits) GROUP BY doc_id, item, p - q, island),
longest AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(own.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

ORACLE = {"op2_minhash": _linked(2, 80, ", sets.doc_id = m.c AS kept"), "op4_decontaminate": _OP4, "op12_jaccard": _linked(3, 90, "")}
