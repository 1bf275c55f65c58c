"""Index lifecycle on plain files: content-addressed generations behind a pointer, replacement, deletion, soft deletion."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import sha256_text


def _contract_hash(contract: dict) -> str:
    return sha256_text(json.dumps(contract, sort_keys=True))


class Generations:
    """Immutable generations `gen=<sha>` under a root that all executors share, and numbered pointer files that name them.

    A build writes its rows aside, names them by contract and content, moves them into place and adds a pointer of the next
    number by one rename, which fails if another build took the number. Readers follow the highest pointer, so they see the old
    or the new generation, never a part and never none. The same contract and content give the same generation, so a
    repeated build changes nothing. Superseded generations stay for their readers until prune.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path("pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _named(self, number: int) -> tuple[str, str]:
        """(generation, hash of its contract) of a pointer."""
        stream = self._fs.open(self._path(f"pointers/{number:09}"))
        try:
            return tuple(bytes(stream.readAllBytes()).decode().split())
        finally:
            stream.close()

    def current(self, contract: dict) -> bool:
        """Whether the active generation was built under this contract."""
        have = self._pointers()
        return bool(have) and self._named(have[-1])[1] == _contract_hash(contract)

    def active(self) -> str | None:
        have = self._pointers()
        return self._named(have[-1])[0] if have else None

    def read(self) -> DataFrame | None:
        name = self.active()
        return None if name is None else self.spark.read.parquet(f"{self.root}/{name}")

    def build(self, rows: DataFrame, contract: dict, partition_by: tuple[str, ...] = (), check=None) -> str:
        """Writes rows as the active generation; check(written rows) may raise, which leaves the former one active."""
        before, aside = self._pointers(), f"aside-{uuid.uuid4().hex}"
        try:
            rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{aside}")
            done = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{aside}")
            if check:
                check(done)
            n, content = done.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0))).first()
            name = "gen=" + sha256_text(json.dumps({"contract": contract, "n": n, "content": str(content), "schema": rows.schema.simpleString()}, sort_keys=True))
            if before and (name, _contract_hash(contract)) == self._named(before[-1]):
                return name
            if not self._fs.exists(self._path(name)) and not self._fs.rename(self._path(aside), self._path(name)):
                raise RuntimeError("the generation could not be moved into place")
            self._point(f"{name} {_contract_hash(contract)}", (before[-1] if before else 0) + 1)
            return name
        finally:
            self._fs.delete(self._path(aside), True)

    def _point(self, content: str, number: int) -> None:
        new, target = self._path(f"pointers/new-{uuid.uuid4().hex}"), self._path(f"pointers/{number:09}")
        out = self._fs.create(new, True)
        out.write(bytearray(content.encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(new, target):
            self._fs.delete(new, False)
            raise RuntimeError("another build has finished first")

    def prune(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` pointers, and generations that no pointer names; returns how many of these went."""
        have = self._pointers()
        for number in have[:-keep]:
            self._fs.delete(self._path(f"pointers/{number:09}"), False)
        named = {self._named(n)[0] for n in have[-keep:]}
        gone = [s.getPath() for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("gen=") and s.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def replace_documents(self, rows: DataFrame, contract: dict, key: str = "document_id", documents: list[str] | None = None, dimension: int | None = None, vector: str = "vector", identity: str | None = None) -> str:
        """A generation in which the documents of rows (or those named) have these rows only; the rest stays.

        Checked before the pointer moves: every vector has the dimension, finite values and unit length; the identity is unique.
        A failure leaves the former generation active, so nothing has to be rolled back.
        """
        now = self.read()
        gone = rows.select(key).distinct() if documents is None else self.spark.createDataFrame([(d,) for d in documents], f"{key} {dict(rows.dtypes)[key]}")
        kept = rows if now is None else now.join(F.broadcast(gone) if documents is not None else gone, key, "left_anti").select(*rows.columns).unionByName(rows)

        def check(done: DataFrame) -> None:
            if dimension is not None:
                from lorespark.operators.dense import vector_faults

                if bad := vector_faults(done, key, vector, dimension).first():
                    raise ValueError(f"{bad[key]}: {bad['reason']}")
            if identity is not None and (twice := done.groupBy(identity).count().where("count > 1").first()):
                raise ValueError(f"{twice[identity]} is there {twice['count']} times")

        return self.build(kept, contract, check=check)

    def replace(self, rows: DataFrame, document: str, contract: dict, key: str = "document_id") -> str:
        """A generation in which the document has these rows only."""
        now = self.read()
        kept = rows if now is None else now.where(F.col(key) != document).unionByName(rows)
        return self.build(kept, contract)

    def delete(self, document: str, contract: dict, key: str = "document_id") -> int:
        """Removes a document; returns how many rows went. Again: 0."""
        now = self.read()
        if now is None or not (n := now.where(F.col(key) == document).count()):
            return 0
        self.build(now.where(F.col(key) != document), contract)
        return n


def replaced(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """now with the rows of every key in new given by new."""
    return now.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def quarantined(index: DataFrame, ids: DataFrame, key: str, value: bool = True) -> DataFrame:
    """index with the flag set (or lifted) for these ids; readers leave flagged rows out."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return index.join(hit, key, "left").withColumn("quarantined", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("quarantined"))).drop("_hit")


def memberships(links: DataFrame) -> DataFrame:
    """local_entity_id, canonical_entity_id, decision_ids (distinct, sorted), primary_decision: merged rows of one membership."""
    g = links.groupBy("local_entity_id", "canonical_entity_id").agg(F.sort_array(F.collect_set("decision_id")).alias("decision_ids"))
    return g.withColumn("primary_decision", F.element_at("decision_ids", 1))


def membership_conflicts(links: DataFrame) -> DataFrame:
    """Entities that would belong to more than one canonical entity."""
    return links.groupBy("local_entity_id").agg(F.countDistinct("canonical_entity_id").alias("n")).where("n > 1")
