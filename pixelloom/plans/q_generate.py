"""Queries: generators, model plug-ins, image scoring and event-time windows, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..generate import run
from ..registry import query
from ..streaming import incremental
from . import derive

#: Side of generated images as a share of the full size (1024): pictures are whole.
SCALE = 1.0
#: Problems a task makes, or makes and scores.
MADE, SCORED = 8, 4
MODELS = ["echo_input", "answer_oracle", "noise"]


def _grid(spark, sf_dir):
    """A problem for every supplier, by its task, mode and visual condition."""
    rows = derive.problems(spark, sf_dir).select(F.col("sid").cast("int").alias("idx"), "task", "mode", "visual_condition")
    return run.slots_of(rows)


@query()
def generate_problems(spark, sf_dir):
    """Full-size pictures and instructions of every supplier's problem."""
    made = run.problems(run.dealt(_grid(spark, sf_dir), MADE), scale=SCALE)
    return made.select("task", "idx", "mode", "visual_condition", "seed", "instruction", F.length("input").alias("input_bytes"), F.length("answer").alias("answer_bytes"))


@query()
def generate_preservation(spark, sf_dir):
    made = run.preservation(run.problems(run.dealt(_grid(spark, sf_dir).where("task = 'removal'"), MADE), scale=SCALE))
    return made.select("task", "idx", "mode", "visual_condition", "seed", (F.col("input") == F.col("answer")).alias("same"))


@query()
def generate_charts(spark, sf_dir):
    """A chart edit for every supplier, as states before and after."""
    task = F.col("task")
    chart = F.coalesce(*(F.when(task.startswith(f"{c}_"), c) for c in dims.CHARTS))
    grid = derive.chart_problems(spark, sf_dir).select(F.col("sid").cast("int").alias("idx"), chart.alias("chart"), F.expr("substring(task, length(chart) + 2)").alias("edit"))
    return run.chart_problems(run.dealt(grid, 400))


@query()
def image_scores(spark, sf_dir):
    """Every supplier's problem, full size, through three baseline models and the image scorer, in one pass a problem."""
    s = run.evaluated(run.dealt(_grid(spark, sf_dir), SCORED), MODELS, scale=SCALE)
    return s.select("model", "task", "idx", "visual_condition", "has_output", "correct_output_size", "edit_pixels", F.element_at("blocks", 3)["iou"].alias("iou"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Tumbling day windows per event type; the same function runs on streams with a watermark."""
    e = derive.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(e, "ts", "event_type", "1 day", "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd"))
