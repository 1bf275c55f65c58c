"""Dense retrieval: validation of vectors and exact top-k by cosine of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespark.operators.sparse import ranked

CELLS = 1 << 20  # scores that one matrix product gives


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_faults(vectors: DataFrame, key: str, vector: str, dimension: int, tolerance: float = 1e-3) -> DataFrame:
    """key, reason of vectors of the wrong dimension, with values that aren't finite, or not of unit length."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    reason = F.when(F.col(vector).isNull() | (F.size(vector) != dimension), "dimension").when(~finite, "not_finite").when(F.abs(norm - 1) > tolerance, "norm")
    return vectors.select(key, reason.alias("reason")).where("reason is not null")


def top_k(queries: DataFrame, vectors: DataFrame, key: str, limit: int, query_id: str = "query_id", query_vector: str = "query_vector", vector: str = "vector", digits: int = 5, most_queries: int = 4096) -> DataFrame:
    """query_id, key, score, rank: exact, ties by key. The stated query set is held against all vectors in blocks of queries.

    Vectors stream past a block of queries once: a matrix product for each Arrow batch, of which only what is among each query's `limit` best of
    the task so far leaves (and whatever rounding might still tie with them); products are of CELLS scores at most. Null vectors are left out; other
    dimensions than the queries' are an error.
    """
    own = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    blocks = max(1, -(-own.count() // most_queries))
    kinds = {"query_id": dict(own.dtypes)["query_id"], key: dict(vectors.dtypes)[key]}
    schema = f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double"
    known = vectors.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    scored = None
    for i in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = block.collect()  # about most_queries vectors
        names = pa.array([r["query_id"] for r in rows], to_arrow_type(own.schema["query_id"].dataType))
        matrix = np.array([r["q"] for r in rows], float)

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            best = np.full((len(names), limit), -np.inf)
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != b.num_rows * matrix.shape[1]:
                    raise ValueError("vectors and queries are of different dimensions")
                for a in range(0, b.num_rows, step := max(1, CELLS // len(names))):
                    part = flat[a * matrix.shape[1] : (a + step) * matrix.shape[1]].reshape(-1, matrix.shape[1])
                    got = matrix @ part.T
                    sound = ~np.isnan(got)
                    best = np.partition(np.concatenate([best, np.where(sound, got, -np.inf)], axis=1), -limit, axis=1)[:, -limit:]
                    x, y = np.nonzero(sound & (got >= best[:, :1] - 2 * 10.0**-digits))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), b.column(0).take(pa.array(y + a)), pa.array(got[x, y])], ["query_id", key, "score"])

        got = known.mapInArrow(run, schema).withColumn("score", F.round("score", digits))
        scored = got if scored is None else scored.unionByName(got)
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc(key)], limit)


def evidence_hits(hits: DataFrame, evidence: str, point: str, limit: int) -> DataFrame:
    """Of ranked representation hits (query_id, evidence, point, score, rank) the best of each evidence (score, rank, point),
    with all its points, ranked anew and cut."""
    order = F.struct((-F.col("score")).alias("s"), F.col("rank").alias("r"), F.col(point).alias("p"))
    best = hits.groupBy("query_id", evidence).agg(F.min(order).alias("b"), F.sort_array(F.collect_set(point)).alias("points"), F.count("*").alias("n_hits"))
    best = best.select("query_id", evidence, (-F.col("b.s")).alias("score"), F.col("b.p").alias("best_point"), F.col("b.r").alias("first_rank"), "points", "n_hits")
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("first_rank"), F.asc("best_point")], limit)


def over_fetch(limit: int, factor: int = 3, most: int = 100) -> int:
    """How many representations are fetched for `limit` evidences; part of the semantics, not a hint."""
    return min(most, max(limit, factor * limit))
