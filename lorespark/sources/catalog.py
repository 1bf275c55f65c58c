"""Catalog scans and JSON sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import clean_comment, clean_type

BLOCK = "type string, page_number int, reading_order int, block_id string, text string, markdown string, html string, latex string, asset_ref string, caption string"
DOCUMENT = f"document_id string, filename string, pages array<struct<page_number:int, blocks:array<struct<{', '.join(x.replace(' ', ':', 1) for x in BLOCK.split(', '))}>>>>"


def columns(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """relation, ordinal, name, type of the tables' columns, from their schemas alone."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString()) for t, df in sorted(frames.items()) for i, f in enumerate(df.schema)]
    df = spark.createDataFrame(rows, "relation string, ordinal int, name string, raw string")
    return df.select("relation", "ordinal", "name", clean_type(F.col("raw")).alias("type"))


def snapshot(cols: DataFrame, keys: DataFrame, allowed: list[str]) -> DataFrame:
    """Foreign keys (source, column, target, target_column) whose both ends are allowed and exist."""
    known = cols.where(F.col("relation").isin(allowed))
    a = known.select(F.col("relation").alias("source"), F.col("name").alias("column"))
    b = known.select(F.col("relation").alias("target"), F.col("name").alias("target_column"))
    return keys.join(a, ["source", "column"], "left_semi").join(b, ["target", "target_column"], "left_semi")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of canonical JSON documents, one file a document, one row a block."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    pages = raw.select("document_id", "filename", F.explode("pages").alias("p"))
    return pages.select("document_id", "filename", F.explode("p.blocks").alias("b")).select("document_id", "filename", "b.*")


def faults(blocks: DataFrame) -> DataFrame:
    """document_id, block_id, reason of blocks that break the model: unknown type, text missing, table with two bodies or none."""
    none = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c]).isNull()
    reason = (
        F.when(~F.col("type").isin("title", "text", "table", "formula", "image"), "type")
        .when(F.col("type").isin("title", "text") & none("text"), "text")
        .when((F.col("type") == "table") & ~none("markdown") & ~none("html"), "two_bodies")
        .when((F.col("type") == "table") & none("markdown", "html", "asset_ref"), "no_body")
        .when((F.col("type") == "formula") & none("latex"), "latex")
        .when((F.col("type") == "image") & none("asset_ref"), "asset")
    )
    return blocks.select("document_id", "block_id", reason.alias("reason")).where("reason is not null")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; a torn last line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, size_bytes, sha256 of the files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def described(cols: DataFrame, comments: DataFrame) -> DataFrame:
    """columns with their comments, cleaned and bounded."""
    return cols.join(comments.select("relation", "name", clean_comment(F.col("comment")).alias("comment")), ["relation", "name"], "left")


def corpus(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The documents of a manifest (document_id, path, sha) with their files' columns (path, ...): of equal contents the one of the
    smallest id stands for all (n_copies); present: whether its file is there."""
    first = manifest.groupBy("sha").agg(F.min(F.struct("document_id", "path")).alias("m"), F.count("*").alias("n_copies"))
    first = first.select("m.document_id", "m.path", "sha", "n_copies")
    return first.join(files.withColumn("present", F.lit(True)), "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def stamp(spark: SparkSession, path: str) -> str:
    """What a table's files are at the moment: a hash of their names, sizes and times."""
    from lorespark.functions.text import sha256_text

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, files = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
    todo = [fs.getFileStatus(p)]
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
        else:
            files.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return sha256_text("\n".join(sorted(files)))
