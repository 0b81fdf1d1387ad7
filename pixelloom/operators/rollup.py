"""Rollups of problem scores: micro at mode and task, macro (means of means) above.

Levels are not grouping sets: an upper level averages the lower level's means with equal weight,
and its spread is that of those means.  Every level is a groupBy on the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import METRICS

STATS = tuple(f"{s}_{m}" for m in METRICS for s in ("mean", "std"))
COUNTS = ("n_problems", "n_with_output", "n_correct_output_size")


def counts() -> list:
    """n_problems, n_with_output (unknown counts as with), n_correct_output_size (unknown doesn't)."""
    return [
        F.count(F.lit(1)).alias("n_problems"), F.count_if(F.coalesce("has_output", F.lit(True))).alias("n_with_output"),
        F.count_if(F.coalesce("correct_output_size", F.lit(False))).alias("n_correct_output_size"),
    ]


def micro(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over problems, per key and block."""
    values = [f.alias(f"{n}_{m}") for m in METRICS for n, f in (("mean", F.coalesce(F.avg(m), F.lit(0.0))), ("std", F.coalesce(F.stddev_pop(m), F.lit(0.0))))]
    return long.groupBy(*keys, "block").agg(*counts(), *values)


def macro(children: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the children's means; problem counts add up."""
    values = [f.alias(f"{n}_{m}") for m in METRICS for n, f in (("mean", F.coalesce(F.avg(f"mean_{m}"), F.lit(0.0))), ("std", F.coalesce(F.stddev_pop(f"mean_{m}"), F.lit(0.0))))]
    return children.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n_tasks"), *(F.sum(c).alias(c) for c in COUNTS), *values)


def mode_rows(long: DataFrame) -> DataFrame:
    """Mode level, for tasks that have more than one mode."""
    several = long.select("model", "task", "mode").distinct().groupBy("model", "task").agg(F.count(F.lit(1)).alias("modes")).where("modes > 1")
    return micro(long.join(several, ["model", "task"], "left_semi"), ["model", "category", "task", "mode"])


def all_levels(long: DataFrame) -> DataFrame:
    """Every level of the problem benchmark as one relation with a ``level`` column.

    ``long``: model, category (null: diagnostic, task rows only), task, mode, visual_condition, flags,
    block, METRICS.
    """
    main = long.where(F.col("category").isNotNull())
    task = micro(long, ["model", "category", "task"])
    by_category = macro(task.where(F.col("category").isNotNull()), ["model", "category"])
    condition = macro(micro(main.where("visual_condition <> ''"), ["model", "visual_condition", "task"]), ["model", "visual_condition"])
    bench = macro(by_category.drop("n_tasks"), ["model"])
    levels = {"mode": mode_rows(main), "task": task, "category": by_category, "visual_condition": condition, "benchmark": bench}
    out = None
    for name, rows in levels.items():
        rows = rows.withColumn("level", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def chart_levels(long: DataFrame) -> DataFrame:
    """Task, chart (as category) and benchmark rows of the chart benchmark.

    ``long``: model, chart, task (label without the chart's name), flags, block, METRICS.
    """
    task = micro(long, ["model", "chart", "task"])
    chart = macro(task, ["model", "chart"])
    bench = macro(chart.drop("n_tasks"), ["model"])
    out = task.withColumn("level", F.lit("task"))
    for name, rows in (("category", chart), ("benchmark", bench)):
        out = out.unionByName(rows.withColumn("level", F.lit(name)), allowMissingColumns=True)
    return out.withColumnRenamed("chart", "category")


LEVEL_ORDER = ("mode", "task", "category", "visual_condition", "benchmark")


def level_ord():
    return F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), F.col("level"))
