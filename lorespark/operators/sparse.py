"""Sparse retrieval: postings, document statistics and BM25, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.functions import text as T
from lorespark.functions.scratch import cut

K1, B = 1.2, 0.75
PAIRS = 2_000_000  # of queries and documents that a task scores


def postings(chunks: DataFrame, keys: list[str], text_col: str = "text", tokens=T.tokens) -> DataFrame:
    """keys, term, tf: term frequencies, added up before the shuffle."""
    return chunks.select(*keys, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def stats(chunks: DataFrame, keys: list[str], text_col: str = "text", tokens=T.tokens) -> DataFrame:
    """keys, dl: the number of tokens, zero included."""
    return chunks.select(*keys, F.greatest(F.size(tokens(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def query_terms(queries: DataFrame, query_id: str, text_col: str = "text", tokens=T.tokens) -> DataFrame:
    """query_id, term: distinct terms of each query; blank queries have none."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def ranked(df: DataFrame, by: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """df with rank, in a total order; Spark prunes groups before the shuffle where there is a limit."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def index_rows(chunks: DataFrame, key: str, text_col: str = "text", tokens=T.tokens, carry: tuple[str, ...] = ()) -> DataFrame:
    """An index: key, dl, term, tf and the carried columns; a row for each term of a chunk, and one without a term for the chunk itself.

    Tokens are counted within their row, so nothing is shuffled.
    """
    one = chunks.select(key, *carry, tokens(F.col(text_col)).alias("t"))
    counted = one.select(key, *carry, F.greatest(F.size("t"), F.lit(0)).alias("dl"), F.sort_array(F.coalesce("t", F.array().cast("array<string>"))).alias("t"))
    # of sorted tokens the places where a new one begins; the distances between them are the frequencies
    places = F.filter(F.sequence(F.lit(0), F.size("t")), lambda i: (i == F.size("t")) | (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    begun = counted.withColumn("p", places)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda j: F.struct(F.get("t", F.get("p", j - 1)).alias("term"), (F.get("p", j) - F.get("p", j - 1)).cast("long").alias("tf")))
    own = F.when(F.size("t") > 0, each).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
    chunk = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf")))
    return begun.select(key, *carry, "dl", F.explode(F.concat(chunk, own)).alias("x")).select(key, *carry, "dl", "x.term", "x.tf")


def search(queries: DataFrame, index: DataFrame, key: str, query_id: str, limit: int | None = 20, scope: Column | None = None, query_text: str = "text", k1: float = K1, b: float = B, tokens=T.tokens, matched: bool = True) -> DataFrame:
    """query_id, key, score, matched_terms (if asked for), rank, from an index.

    The scope (a filter of the index's key and carried columns) holds for everything: number of documents (empty ones too), mean
    length, document frequency. Only postings of query terms are joined; scores are rounded before they are ranked, so that ties are ties.

    Postings are shuffled once, by document; pairs of queries and documents, of which there may be as many as both together, are scored and cut to
    each query's best where they arise. Matched terms are looked up for what is found alone.
    """
    index = index.where(scope) if scope is not None else index
    terms = query_terms(queries, query_id, query_text, tokens)
    n, mean = index.where("term is null").agg(F.count("*"), F.avg("dl")).first()
    wanted = terms.select("term").distinct()
    small = lambda df: F.broadcast(df) if _few(df) else df
    hits = index.where("term is not null").select("term", key, "tf", "dl").join(small(wanted), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean or 1.0))))
    asked = terms.join(df, "term").select("query_id", "term", idf.alias("idf"))
    asked = F.broadcast(asked) if _few(terms) else asked
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) * terms.select("query_id").distinct().count() // PAIRS))
    own = hits.select("term", key, weight.alias("w")).repartition(parts, key)
    scored = own.join(asked, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("idf") * F.col("w")), 6).alias("score"))
    top = ranked(scored, ["query_id"], [F.desc("score"), F.asc(key)], limit)
    if not matched:
        return top
    top = cut(top)
    found = hits.select(key, "term").join(small(top.select("query_id", key)), key).join(terms, ["query_id", "term"])
    found = found.groupBy("query_id", key).agg(F.array_sort(F.collect_list("term")).alias("matched_terms"))
    return top.join(found, ["query_id", key]).select("query_id", key, "score", "matched_terms", "rank")


def _few(terms: DataFrame, most: int = 100_000) -> bool:
    return terms.limit(most + 1).count() <= most


def bm25(queries: DataFrame, chunks: DataFrame, key: str, query_id: str, limit: int = 20, scope: Column | None = None, text_col: str = "text", query_text: str = "text", k1: float = K1, b: float = B, tokens=T.tokens, matched: bool = True) -> DataFrame:
    """search over an index of the chunks that the scope admits, made for this call.

    search reads its index several times; the index is written in between, so that chunks are split into tokens once. Of its postings those of query terms are kept.
    """
    chunks = chunks.where(scope) if scope is not None else chunks
    index = index_rows(chunks, key, text_col, tokens)
    wanted = query_terms(queries, query_id, query_text, tokens).select("term").distinct()
    if _few(wanted):
        index = index.join(F.broadcast(wanted.withColumn("_asked", F.lit(True))), "term", "left").where("term is null or _asked").drop("_asked")
    return search(queries, cut(index), key, query_id, limit, None, query_text, k1, b, tokens, matched)


def index_status(expected: DataFrame, stored: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """status (missing, stale, incompatible, ready) and n of expected and stored chunks."""
    both = expected.select(*keys, F.col(fingerprint).alias("e")).join(stored.select(*keys, F.col(fingerprint).alias("s")), keys, "full_outer")
    status = F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "stale").when(F.col("e") != F.col("s"), "incompatible").otherwise("ready")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def ranking_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """query_id, n_a, n_b, n_both, n_only_a, n_only_b of two rankings (query_id, key, rank)."""
    one = lambda df, c: df.groupBy("query_id").agg(F.collect_set(key).alias(c))
    both = one(a, "a").join(one(b, "b"), "query_id", "full_outer")
    none = F.array().cast(f"array<{dict(a.dtypes)[key]}>")
    both = both.select("query_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return both.select("query_id", n(F.col("a"), "n_a"), n(F.col("b"), "n_b"), n(F.array_intersect("a", "b"), "n_both"), n(F.array_except("a", "b"), "n_only_a"), n(F.array_except("b", "a"), "n_only_b"))
