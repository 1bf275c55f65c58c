"""Shared pieces of the training-data operators: tables, shared scratch, vectorised word hashing.

Word hashing works on the UTF-8 bytes of a whole Arrow batch at once: a byte class table marks word bytes, and a
multilinear 64-bit hash (random odd multiplier per position, random value per byte) is summed per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import ship

U = np.uint64
_written: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode, where it is unset."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        _written.append((spark._jvm, where))
    return where


@atexit.register
def _sweep() -> None:
    for jvm, path in _written:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # the session has ended before us
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, gives pruned columns back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark._jvm, path))
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES = 4 << 20  # at most so much text in a batch on its way to Python, whatever the number of rows


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship.shipped(spark)


def give_back() -> None:
    """Returns freed memory to the system, so that what one task or slice needed isn't held while others run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); a task that has ended leaves no memory behind in its Python worker."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return df.mapInArrow(tidy, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Only id and text, under our own names, so other columns can't clash; a null text is empty. carry: row has all columns."""
    shipped(docs.sparkSession)
    rest = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] * carry
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about `most` bytes in the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
            give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_GOLD = U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=U) * _GOLD)
_PLACE = mix(np.arange(1000, 1000 + 4096, dtype=U) * _GOLD) | U(1)


def _places(n: int) -> np.ndarray:
    return _PLACE if n <= len(_PLACE) else mix(np.arange(1000, 1000 + n, dtype=U) * _GOLD) | U(1)


def classes(separators) -> np.ndarray:
    """Mask over the 256 bytes: False for separators."""
    mask = np.ones(256, bool)
    mask[list(separators)] = False
    return mask


SPACES = classes([0x20, *range(0x09, 0x0E)])
ALNUM = classes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a batch of texts, in order: start and end in the bytes, text number, 64-bit hash.

    data: bytes, lower-cased (A-Z only) unless asked otherwise; inside: mask of word bytes; n: words of each text.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, mask: np.ndarray = SPACES, hashed: bool = True, lower: bool = True):
        self.data, self.off = LOWER[data] if lower else data, off
        size, count = len(data), len(off) - 1
        self.inside = mask[self.data]
        edge = np.zeros(size + 1, bool)
        edge[off] = True
        before = np.concatenate(([False], self.inside[:-1])) if size else self.inside
        after = np.concatenate((self.inside[1:], [False])) if size else self.inside
        self.start = np.flatnonzero(self.inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(off[1:], self.start, "right")
        self.n = np.bincount(self.text, minlength=count).astype(np.int64)
        self.length = self.end - self.start
        self.first = np.concatenate(([0], np.cumsum(self.n)))  # of each text, among the words
        if hashed:
            self.hash = self._hash()

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """(running sums over word bytes, first place of each word in them)."""
        at = np.cumsum(self.length) - self.length
        w = self.data[self.inside]
        place = np.arange(len(w)) - np.repeat(at, self.length)
        value = _BYTE[w] * _places(int(self.length.max(initial=0)))[place]
        return value, at

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, U)
        value, at = self.summed()
        return mix(np.add.reduceat(value, at) ^ (self.length.astype(U) * _GOLD))


def word_hash(word: bytes) -> int:
    """The hash that Words gives this word (lower-cased already)."""
    w = np.frombuffer(word, np.uint8)
    value = np.add.reduce(_BYTE[w] * _places(len(w))[: len(w)])
    return int(mix(np.array([value ^ (U(len(w)) * _GOLD)], U))[0])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text): the distinct k-word shingles of each text, sorted within it.

    A text of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    h, n = words.hash, words.n
    factor = mix(np.arange(7, 7 + k, dtype=U) * _GOLD) | U(1)
    total = np.zeros(len(h), U)
    for j in range(k):
        total[: len(h) - j] += h[j:] * factor[j] if j < len(h) else U(0)
    full = mix(total + U(k))
    out, first = [], [0]
    for i in range(len(n)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix(np.array([np.add.reduce(h[a:b] * factor[: b - a]) + U(b - a)], U))
        else:
            s = np.empty(0, U)
        out.append(s)
        first.append(first[-1] + len(s))
    return (np.concatenate(out) if out else np.empty(0, U)), np.array(first)
