"""JSON-lines relations: per-problem records, aggregate rows, manifests, inference metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "struct<edit_correct_pixels: double, preservation_correct_pixels: double, edit_accuracy: double, preservation_accuracy: double, iou: double, changed_pixels: double>"
PROBLEM_STATS = (
    "model string, benchmark string, task string, mode string, visual_condition string, idx int, input_size array<int>, bg_colors array<string>, has_output boolean, correct_output_size boolean, "
    f"output struct<output_size: array<int>, edit_pixels: long, preservation_pixels: long, cie76_threshold: map<string, {_BLOCK}>, cie76_mean: {_BLOCK}>"
)
METRICS = (
    "tasks map<string, struct<task_id: string, problems: array<struct<index: int, task: string, mode: string, visual_condition: string, success: boolean, skipped: boolean, error: string, inference_time_s: double>>>>"
)


def problem_stats(spark: SparkSession, path: str) -> DataFrame:
    """Nested records; a missing mode is the empty string, broken lines are dropped."""
    rows = spark.read.schema(PROBLEM_STATS).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("mode", F.coalesce("mode", F.lit("")))


def long_form(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and block ('0' .. '10' and 'mean'); a missing changed_pixels is 0."""
    blocks = F.map_concat("output.cie76_threshold", F.create_map(F.lit("mean"), F.col("output.cie76_mean")))
    rows = stats.select(*keys, "has_output", "correct_output_size", F.explode(blocks).alias("block", "b"))
    return rows.select(*keys, "has_output", "correct_output_size", "block", "b.edit_accuracy", "b.preservation_accuracy", "b.iou", F.coalesce("b.changed_pixels", F.lit(0.0)).alias("changed_pixels"))


def aggregate_stats(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """Aggregate rows without the models whose name holds one of ``exclude``."""
    rows = spark.read.json(path)
    for part in exclude or []:
        rows = rows.where(~F.contains("model", F.lit(part)))
    return rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """problems.jsonl; blank and corrupt lines are skipped."""
    return spark.read.schema("category string, task string, mode string, visual_condition string, problem_id long, instruction string").option("mode", "DROPMALFORMED").json(path).where("task IS NOT NULL")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Problems of an inference metrics document, one row each."""
    doc = spark.read.schema(METRICS).option("multiLine", True).json(path)
    rows = doc.select(F.explode("tasks").alias("task_key", "t")).select("task_key", F.explode("t.problems").alias("p"))
    return rows.select(F.coalesce("p.task", "task_key").alias("task"), F.col("p.index").alias("idx"), "p.mode", "p.visual_condition", "p.success", F.coalesce("p.skipped", F.lit(False)).alias("skipped"), F.col("p.inference_time_s").alias("latency"), "p.error")
