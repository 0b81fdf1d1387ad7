"""Incremental evaluation as Structured Streaming, and aggregations over event time.

New outputs arrive through the file source; each micro-batch is upserted into a keyed table, the
latest time winning, so late and repeated arrivals are idempotent.  The file source knows a file by
its name and doesn't look at it again, so rewritten outputs are found by ``refresh``: a batch that
compares the files' times with the table's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.planning import latest

KEYS = ["model", "benchmark", "task", "idx"]


def _files(reader, root: str) -> DataFrame:
    rows = (
        reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*_output.png").load(root)
    )
    part = lambda n: F.element_at(F.split("path", "/"), -n)
    return rows.select(
        part(4).alias("model"), part(3).alias("benchmark"), part(2).alias("task"), F.regexp_extract("path", r"(\d+)_output\.png$", 1).cast("long").alias("idx"),
        F.col("modificationTime").alias("time"), "length", "content",
    )


def output_stream(spark: SparkSession, root: str) -> DataFrame:
    """model, benchmark, task, idx, time, length, content of output files as they appear."""
    return _files(spark.readStream, root)


def refresh(spark: SparkSession, root: str, table: str, score: Callable[[DataFrame], DataFrame]) -> int:
    """Score again the outputs that are newer than their row in the table; returns how many.

    Only the files' names and times are read to find them; contents of the others stay unread.
    """
    have = current(spark, table).select(*KEYS, F.col("time").alias("_seen"))
    found = _files(spark.read, root)
    stale = found.select(*KEYS, "time").join(have, KEYS, "left").where("_seen IS NULL OR time > _seen").select(*KEYS)
    n = stale.count()
    if n:
        upsert(spark, table, score(found.join(stale, KEYS, "left_semi")))
    return n


def upsert(spark: SparkSession, table: str, rows: DataFrame, keys: list[str] = KEYS, time: str = "time") -> None:
    """Merge ``rows`` into the Parquet table: a new version is written beside the old and its number advanced."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    have = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")) if fs.exists(root) else []
    merged = rows if not have else rows.unionByName(spark.read.parquet(f"{table}/v={have[-1]}"))
    latest(merged, keys, time).write.parquet(f"{table}/v={(have[-1] + 1) if have else 0}")
    for old in have[:-1]:
        fs.delete(fs_path(f"{table}/v={old}"), True)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table's latest version."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = max(int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v="))
    return spark.read.parquet(f"{table}/v={top}")


def evaluate(stream: DataFrame, table: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Score what arrives and keep the table current; ``trigger`` defaults to all that is there, then stop."""

    def batch(rows: DataFrame, _: int) -> None:
        upsert(rows.sparkSession, table, score(rows))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Events per key and tumbling window, late ones up to ``late`` included (works on streams and tables)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
