"""Files read in their order: runs of rows that belong together, and append-only logs whose last line may be torn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1_000_000  # rows of a file that one window looks at
TAIL = 1 << 16  # bytes that are read at a time to find a file's last line


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table's rows with _file and _row: the file, and the place in it; files are in the order of their names."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def runs(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """key, _file, _row (where the run begins), n: runs of neighbouring rows of one key in file order.

    Rows meet only within a block of a file; the first and last key of each block are then stitched together in a table of blocks. So a file of any
    length is no single task, and only as many rows are in order at once as there are blocks.
    """
    at = ["_file", "_block"]
    rows = rows.withColumn("_block", F.floor(F.col("_row") / block))
    w = Window.partitionBy(*at).orderBy("_row")
    begins = ~F.coalesce(F.lag(key).over(w).eqNullSafe(F.col(key)), F.lit(False)) | (F.row_number().over(w) == 1)
    inner = rows.select(key, *at, "_row", begins.alias("_begins"), F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    pieces = inner.groupBy(*at, "_run").agg(F.first(key).alias(key), F.min("_row").alias("_row"), F.count("*").alias("n"))
    ends = pieces.groupBy(*at).agg(F.min_by(key, "_run").alias("_first"), F.max_by(key, "_run").alias("_last"), F.max("_run").alias("_runs"))
    order = Window.orderBy("_file", "_block")  # one row a block
    goes_on = F.lag("_last").over(order).eqNullSafe(F.col("_first")) & (F.row_number().over(order) > 1)
    ends = ends.withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
    # a run that fills whole blocks goes on through them: its number is that of the last block in which a run begins
    start = F.last(F.when(~F.col("_goes_on") | (F.col("_runs") > 1), F.struct(*at, F.when(F.col("_runs") > 1, F.col("_runs")).otherwise(F.lit(1)).alias("_run"))), ignorenulls=True)
    ends = ends.withColumn("_open", start.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    both = pieces.join(ends.select(*at, "_goes_on", "_open"), at)
    name = F.when(F.col("_goes_on") & (F.col("_run") == 1), F.col("_open")).otherwise(F.struct(*at, F.col("_run")))
    return both.groupBy(name.alias("_name")).agg(F.min_by(key, F.struct(*at)).alias(key), F.min(F.struct("_file", "_row")).alias("_at"), F.sum("n").alias("n")).select(key, "_at._file", "_at._row", "n")


def reappearing(found: DataFrame, key: str) -> DataFrame:
    """key, runs: keys whose rows don't stand together."""
    return found.groupBy(key).agg(F.count("*").alias("runs")).where("runs > 1")


def contiguous_rows(rows: DataFrame, key: str) -> DataFrame:
    """rows, once it is sure that every key's rows stand together; a key that comes back after its run is an error."""
    if again := reappearing(runs(rows, key), key).first():
        raise ValueError(f"{again[key]} comes back after its run ({again['runs']} runs)")
    return rows


class Log:
    """An append-only log of JSON lines in one or more files. A write that was cut off leaves a last line without its end; that line alone may be
    dropped, or cut off for good. A bad line anywhere else is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getScheme() == "file":  # without files of checksums, which other writers of a local log don't keep
            self._fs = self._fs.getRawFileSystem()

    def _files(self) -> list:
        top = self._hadoop.Path(self.path)
        if not self._fs.exists(top):
            return []
        own = self._fs.listStatus(top)
        return sorted((s for s in own if s.isFile() and not s.getPath().getName().startswith((".", "_"))), key=lambda s: s.getPath().toString())

    def torn(self) -> dict[str, tuple[int, bytes]]:
        """For each file that doesn't end with a line's end: where its last line begins, and what there is of it. Reads the files' ends only."""
        out = {}
        for s in self._files():
            size, tail = s.getLen(), b""
            stream = self._fs.open(s.getPath()) if size else None
            try:
                while stream and len(tail) < size and b"\n" not in tail:
                    n = min(TAIL, size - len(tail))
                    stream.seek(size - len(tail) - n)
                    tail = bytes(stream.readNBytes(n)) + tail
            finally:
                if stream:
                    stream.close()
            last = tail[tail.rfind(b"\n") + 1 :]
            if last:
                out[s.getPath().toString()] = (size - len(last), last)
        return out

    def read(self, schema: str) -> DataFrame:
        """The records, with _file; a torn last line is left out if it is no record, a bad line elsewhere fails the query, blank lines don't count."""
        corrupt = "_bad"
        lines = self.spark.read.option("wholetext", False).text(self.path).select(F.col("value"), F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
        torn = [(f, line.decode("utf-8", "replace").strip()) for f, (_, line) in self.torn().items()]  # one line a file
        ends = self.spark.createDataFrame(torn, "_file string, _line string").withColumn("_torn", F.lit(True))
        known = lines.join(F.broadcast(ends), (lines["_file"] == ends["_file"]) & (F.trim("value") == ends["_line"]), "left").select("value", lines["_file"], "_torn")
        got = known.withColumn("r", F.from_json("value", f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
        bad = F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull()
        got = got.where(~(bad & F.coalesce("_torn", F.lit(False))))
        checked = F.when(bad, F.raise_error(F.concat(F.lit("a bad line in "), F.col("_file")))).otherwise(F.col("r"))
        return got.select("_file", checked.alias("r")).select("_file", "r.*").drop(corrupt)

    def repair(self) -> int:
        """Cuts torn last lines off that are no JSON, and ends those that are; returns how many files changed. Each file is written aside and put in place by a rename."""
        changed = 0
        for name, (start, line) in self.torn().items():
            path, aside = self._hadoop.Path(name), self._hadoop.Path(f"{name}.repair")
            whole = self.spark.createDataFrame([(line.decode("utf-8", "replace"),)], "l string").select(F.try_parse_json("l").isNotNull()).first()[0]
            source, target = self._fs.open(path), self._fs.create(aside, True)
            try:
                left = start
                while left:
                    part = source.readNBytes(min(left, 1 << 20))
                    target.write(part)
                    left -= len(part)
                if whole:
                    target.write(bytearray(line + b"\n"))
            finally:
                source.close()
                target.close()
            self._fs.delete(path, False)
            self._fs.rename(aside, path)
            changed += 1
        return changed
