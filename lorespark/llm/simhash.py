"""Document fingerprints by SimHash, in DataFrame functions alone.

Terms are a text's 2-word shingles (a single word where there is but one), lower-cased, weighted by their length up to 16
(long ones are rarer). Each term's hash votes with its weight on 128 signed bits. Two bit counters share a long, so 64 sums
pre-aggregate in the task that reads the text. Permuted block tables find all fingerprints within a Hamming radius.

Cases: null texts are empty; a text without words has the zero fingerprint; equal texts have equal fingerprints; rows that
repeat a doc_id are ordered by text; of one document, the next is itself; an empty table gives an empty result; other columns
are ignored. A text may have 2^27 terms.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, native

BITS = 128
RADIUS = 6  # bits that near fingerprints may differ in
_LANES = (1 << 32) + 1


def terms(text: Column) -> Column:
    """array<struct<h: hash, w: weight>> of the terms."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def term(i: Column, words: Column) -> Column:
        a, b = F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(""))
        return F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.length(b), F.lit(16)).cast("long").alias("w"))

    def of(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: term(i, words)))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fp (array of two longs); the keys must tell rows apart."""
    votes = texts.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("t"))
    votes = votes.select(*keys, F.col("t.h").alias("h0"), F.xxhash64("t.h", F.lit(1)).alias("h1"), F.coalesce("t.w", F.lit(0)).alias("w"))
    sums = [F.sum(F.shiftrightunsigned(f"h{j}", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{j}_{i}") for j in (0, 1) for i in range(32)]
    got = votes.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)

    def bit(j: int, i: int) -> Column:
        both = F.coalesce(F.col(f"s{j}_{i % 32}"), F.lit(0).cast("long"))
        votes = F.shiftrightunsigned(both, 32) if i >= 32 else both.bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft((votes * 2 > F.col("all")).cast("long"), i)

    def part(j: int) -> Column:
        out = bit(j, 0)
        for i in range(1, 64):
            out = out.bitwiseOR(bit(j, i))
        return out

    return got.select(*keys, F.array(part(0), part(1)).alias("fp"))


def shown(fp: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(fp, F.lit(i))), 16, "0")) for i in (0, 1)])


def _bucketed(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """docs with bucket: ranges of doc_id of about equal count, whose bounds come from quantiles over all rows."""
    n = per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return docs.withColumn("bucket", F.lit(0))
    side = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    literal = lambda v: F.expr(f"array({', '.join(f'{x}L' for x in v)})")
    table = F.array(*[literal(r) for r in rows])
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col("doc_id")))
    outer = F.greatest(below(literal([r[0] for r in rows])) - 1, F.lit(0))
    return docs.withColumn("outer", outer).withColumn("bucket", F.col("outer") * side + below(F.get(table, F.col("outer")))).drop("outer")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with bucket, rn, own, next (text of the next document by doc_id, after the last the first's).

    The rows of a bucket are followed by a copy of the first row after it (own: false), so each bucket is complete in itself
    and the texts are shuffled once.
    """
    df = _bucketed(docs.select("doc_id", "text").where("doc_id is not null"))
    heads = df.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    found = sorted((r["bucket"], r["doc_id"]) for r in heads.collect())  # one row a bucket
    edges = [(b, found[(i + 1) % len(found)][1]) for i, (b, _) in enumerate(found)]
    spark = docs.sparkSession
    edge = spark.createDataFrame(edges, "bucket int, doc_id long")
    first = docs.select("doc_id", "text").join(F.broadcast(edge), "doc_id").groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    both = df.select("bucket", "doc_id", "text", F.lit(True).alias("own")).unionByName(first.withColumn("own", F.lit(False)))
    w = Window.partitionBy("bucket").orderBy(F.desc("own"), "doc_id", "text")
    return both.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, query_every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of each document with an id.

    n_near: where the id is divisible by query_every, the number of other documents within the radius, else null.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(texts).withColumn("edited", edited(F.col("text"), F.col("next"))).drop("next")
    keys = ["bucket", "rn", "doc_id", "own", "n_chars", "edited_sha256"]
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v")).select(*keys, "v.which", F.col("v.t").alias("t"))
    fp = fingerprints(both, [*keys, "which"], "t")
    w = Window.partitionBy("bucket").orderBy("rn")
    fp = fp.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited"))
    fp = fp.withColumn("next", F.lead("fp").over(w)).where("own")
    near = lambda c: native.likeness(F.col("fp"), F.col(c), BITS)
    fp = common.written(fp.withColumn("query", F.col("doc_id") % query_every == 0), "edited-fingerprints")
    found = near_counts(fp.select("fp", "query"), radius).withColumnRenamed("q", "fp")
    asked = fp.where("query").join(found, "fp").withColumn("n_near", F.col("n") - 1)
    fp = asked.drop("n").unionByName(fp.where("not query").withColumn("n_near", F.lit(None).cast("long")))
    return fp.select("doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"), "n_near")


def tables(radius: int, blocks: int | None = None) -> list[tuple[tuple[int, ...], list[int]]]:
    """(blocks, their bits as two masks) of each table: choices of blocks - radius of the blocks that 128 bits are cut into."""
    blocks = blocks or (radius + 2 if radius <= 8 else radius + 1)
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("more blocks than the radius are needed, and no more than there are bits")
    bits = [[i for i in range(BITS) if i * blocks // BITS == b] for b in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    mask = lambda own, half: signed(sum(1 << (i % 64) for b in own for i in bits[b] if i // 64 == half))
    return [(c, [mask(c, 0), mask(c, 1)]) for c in combinations(range(blocks), blocks - radius)]


def within(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """q, x, distance: all pairs of distinct fingerprints, q of queries and x of index (fp), at most `radius` bits apart.

    128 bits are cut into blocks (radius + 2 unless given; radius + 1 beyond 8). Fingerprints that are so near agree in blocks - radius
    of them at least; each choice of so many blocks is a table, keyed by their bits, so no pair is missed. A pair counts in
    the first table that it agrees in, so nothing has to be made distinct. Keys that many share are split as skewed joins.
    """
    made = tables(radius, blocks)
    masked = lambda fp, m: [F.get(fp, F.lit(i)).bitwiseAND(F.lit(m[i])) for i in (0, 1)]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *masked(F.col("fp"), m)).alias("key")) for t, (_, m) in enumerate(made)]))
    q = queries.select("fp").distinct().select(F.col("fp").alias("q"), keys.alias("k")).select("q", "k.*")
    x = index.select("fp").distinct().select(F.col("fp").alias("x"), keys.alias("k")).select("x", "k.*")
    q, x = common.written(q, "query-keys"), common.written(x, "index-keys")
    off = F.zip_with("q", "x", lambda a, b: a.bitwiseXOR(b))
    distance = F.aggregate(F.transform("off", F.bit_count), F.lit(0), lambda s, v: s + v)
    pairs = q.join(x, ["table", "key"]).select("q", "x", "table", off.alias("off")).where(distance <= radius)
    agree = F.transform(F.array(*[F.array(*map(F.lit, m)) for _, m in made]), lambda m: F.aggregate(F.zip_with("off", m, lambda a, b: a.bitwiseAND(b)), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v)) == 0)
    return pairs.where(F.array_position(agree, True) == F.col("table") + 1).select("q", "x", distance.alias("distance"))


def near_counts(fps: DataFrame, radius: int) -> DataFrame:
    """q and n: for each fingerprint of the query rows (query: true), how many rows (itself included) are within the radius."""
    index = common.written(fps.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    pairs = within(fps.where("query"), index, radius)
    return pairs.join(index.withColumnRenamed("fp", "x"), "x").groupBy("q").agg(F.sum("n").alias("n"))
