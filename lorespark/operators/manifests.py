"""Indexes as manifests of immutable partitions: a document's replacement rewrites its partition, not the index.

The rows of each table are dealt into buckets by their document's hash. A manifest names, for each table and bucket, the folder that holds it, and
never changes; neither do the folders. A change writes new folders for the buckets it touches and a manifest that names them next to the old
ones of all others. It becomes visible by taking the next number: an exclusive creation, so of two writers who started from one manifest the second
fails, and nothing of its work is seen. The tables of one manifest (chunks, vectors, evidence) are therefore always of one state, and a failed
check leaves all of them as they were. Readers of documents read those documents' buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorespark.functions.text import sha256_text

BUCKET_ROWS = 200_000  # rows that a bucket of the largest table should hold


class Conflict(RuntimeError):
    """Another writer has changed the index since this one read it."""


class Index:
    """Tables under a root that all executors share, each with a key column that names a row's document."""

    def __init__(self, spark: SparkSession, root: str, key: str = "document_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    # numbers and manifests

    def numbers(self) -> list[int]:
        """The numbers taken so far, those of writers that died in between included."""
        at = self._path("numbers")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def manifest(self, number: int | None = None) -> tuple[int, dict] | None:
        """(number, manifest) of a number, or of the last one that was completed."""
        for n in reversed(self.numbers()) if number is None else [number]:
            if (named := self._text(f"numbers/{n:09}")).endswith("\n"):  # else its writer died, or is about to end
                return n, json.loads(self._text(f"manifests/{named.strip()}"))
        return None

    def _take(self, number: int, manifest: dict) -> int:
        body = f"{uuid.uuid4().hex}.json"
        self._write(f"manifests/{body}", json.dumps(manifest, sort_keys=True))
        name = f"numbers/{number:09}"
        self._fs.mkdirs(self._path("numbers"))
        try:
            if self._fs.getScheme() == "file":  # the local file system of Hadoop looks first and creates then
                if not self._jvm.java.io.File(self._path(name).toUri().getPath()).createNewFile():
                    raise FileExistsError("AlreadyExists")
            else:
                self._fs.create(self._path(name), False).close()
        except Exception as e:
            self._fs.delete(self._path(f"manifests/{body}"), False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"number {number} has been taken") from e
            raise
        self._write(name, body + "\n")
        return number

    # rows

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def _stored(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Folders by bucket of rows, once they are written."""
        part = f"parts/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(buckets))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{part}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(part))]
        return {n.removeprefix("_bucket="): f"{part}/{n}" for n in made if n.startswith("_bucket=")}

    def _rows(self, table: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, name: str, documents: list | None = None, number: int | None = None) -> DataFrame | None:
        """A table as the manifest has it, of some documents only if asked: just their buckets are read then."""
        if (found := self.manifest(number)) is None:
            return None
        table = found[1]["tables"][name]
        if documents is None:
            return self._rows(table, sorted(table["folders"].values()))
        near = self._buckets_of(documents, found[1]["buckets"])
        return self._rows(table, [f for b, f in sorted(table["folders"].items()) if b in near]).where(F.col(self.key).isin(documents))

    def _buckets_of(self, documents: list, buckets: int) -> set[str]:
        if not documents:
            return set()
        rows = self.spark.createDataFrame([(str(d),) for d in documents], f"{self.key} string")
        return {str(r.b) for r in rows.select(self._bucket(buckets).alias("b")).distinct().collect()}

    # changes

    def build(self, tables: dict[str, DataFrame], contract: dict, check: Callable[[dict[str, DataFrame]], None] | None = None, bucket_rows: int = BUCKET_ROWS) -> int:
        """The tables as a new state; the number of buckets follows the rows of the largest, so that a bucket's size doesn't grow with the index."""
        if check:
            check(tables)
        before = self.numbers()
        buckets = max(1, -(-max(rows.count() for rows in tables.values()) // bucket_rows))
        made = {n: {"schema": rows.schema.jsonValue(), "folders": self._stored(rows, buckets)} for n, rows in tables.items()}
        return self._finish(before, {"contract": _hash(contract), "buckets": buckets, "tables": made})

    def _finish(self, before: list[int], manifest: dict) -> int:
        try:
            return self._take((before[-1] if before else 0) + 1, manifest)
        except Conflict:
            self._sweep(manifest)
            raise

    def _sweep(self, manifest: dict) -> None:
        """Deletes what a failed change has written: folders that no completed manifest names."""
        named = self._named(self.numbers())
        for folder in {f for t in manifest["tables"].values() for f in t["folders"].values()} - named:
            self._fs.delete(self._path(folder), True)

    def _named(self, numbers: list[int]) -> set[str]:
        manifests = [self.manifest(n) for n in numbers]
        return {f for m in manifests if m for t in m[1]["tables"].values() for f in t["folders"].values()}

    def replace(self, tables: dict[str, DataFrame], contract: dict, documents: list | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None, unique: dict[str, str] | None = None) -> int:
        """A state in which the documents (those that the rows name, or those given) have these rows only, in every table given.

        The contract must be the index's; check(new rows) may raise; unique names a column of a table whose values may be in no row of another
        document. Only the documents' buckets are read and written; whatever fails, the former state stays.
        """
        before = self.numbers()
        if (found := self.manifest()) is None:
            return self.build(tables, contract, check)
        manifest = found[1]
        if manifest["contract"] != _hash(contract):
            raise ValueError("the index was built under another contract")
        for n, rows in tables.items():
            if rows.schema.jsonValue() != manifest["tables"][n]["schema"]:
                raise ValueError(f"{n}: other columns than the index has")
        if check:
            check(tables)
        names = [rows.select(F.col(self.key).cast("string").alias(self.key)).distinct() for rows in tables.values()]
        gone = names[0]
        for more in names[1:]:
            gone = gone.unionByName(more).distinct()
        if documents is not None:
            gone = self.spark.createDataFrame([(str(d),) for d in documents], f"{self.key} string")
            for n, rows in tables.items():
                if not rows.select(F.col(self.key).cast("string").alias(self.key)).join(gone, self.key, "left_anti").isEmpty():
                    raise ValueError(f"{n}: rows of other documents")
        touched = {str(r.b) for r in gone.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()}  # as many as there are buckets at most
        for n, column in (unique or {}).items():
            if twice := self._twice(manifest, n, tables[n], column, gone):
                raise ValueError(f"{n}: {twice} is there already")
        new = {k: v for k, v in manifest.items() if k != "tables"} | {"tables": dict(manifest["tables"])}
        for n, rows in tables.items():
            table = manifest["tables"][n]
            old = self._rows(table, [f for b, f in table["folders"].items() if b in touched])
            kept = old.withColumn("_k", F.col(self.key).cast("string")).join(gone.withColumnRenamed(self.key, "_k"), "_k", "left_anti").drop("_k")
            folders = {b: f for b, f in table["folders"].items() if b not in touched} | self._stored(kept.select(*rows.columns).unionByName(rows), manifest["buckets"])
            new["tables"][n] = table | {"folders": folders}
        return self._finish(before, new)

    def _twice(self, manifest: dict, name: str, rows: DataFrame, column: str, gone: DataFrame):
        """A value of the column that stands twice in rows, or in a row of the index that stays."""
        if again := rows.groupBy(column).count().where("count > 1").first():
            return again[column]
        table = manifest["tables"][name]
        kept = self._rows(table, sorted(table["folders"].values())).select(column, F.col(self.key).cast("string").alias(self.key)).join(gone, self.key, "left_anti")
        both = kept.join(rows.select(column), column, "left_semi").first()
        return both and both[column]

    def delete(self, documents: list, contract: dict) -> int:
        """Removes documents from all tables."""
        _, manifest = self.manifest()
        none = {n: self._rows(t, []) for n, t in manifest["tables"].items()}
        return self.replace(none, contract, documents)

    def roll_back(self, number: int) -> int:
        """The state of a former number becomes that of the next."""
        before = self.numbers()
        return self._take(before[-1] + 1, self.manifest(number)[1])

    def prune(self, keep: int = 2) -> int:
        """Forgets all but the last `keep` numbers; returns how many folders, which no other names, went."""
        have = self.numbers()
        old, new = have[:-keep], have[-keep:]
        gone = self._named(old) - self._named(new)
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        for n in old:
            self._fs.delete(self._path(f"numbers/{n:09}"), False)
        return len(gone)


def _hash(contract: dict) -> str:
    return sha256_text(json.dumps(contract, sort_keys=True))
