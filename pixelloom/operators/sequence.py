"""Operators on ordered rows: ranks, gaps, runs, clipping, rescaling of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def global_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Place (from 1) in the total order by ``keys``, nulls first, without sorting all rows in one task.

    Rows are dealt by ranges of their keys, sorted and numbered where they are, and stored; a running sum over the ranges (one
    row each, whatever the data) gives each range its start.  Ties share nothing: equal rows get different places.
    """
    at = F.monotonically_increasing_id()  # the range above, the place in it in the lower 33 bits
    own = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    own = own.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    own = stored(own, "order")
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return own.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_place") + 1).cast("long")).drop("_range", "_start", "_place")  # a row a partition


def runs_of(rows: DataFrame, key: str, index: str, size: str = "n") -> DataFrame:
    """Contiguous runs of integer ``index`` per key: first, last and number of members."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    return rows.withColumn("_island", island).groupBy(key, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias(size)).drop("_island")


def monotone(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key: is ``value`` non-decreasing, non-increasing along ``order``?"""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    step = rows.withColumn("_d", F.col(value) - before)
    return step.groupBy(key).agg(F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("is_ascending"), F.coalesce(F.bool_and(F.col("_d") <= 0), F.lit(True)).alias("is_descending"))


def min_gap(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Per key: least distance of sorted neighbours, range, and whether the one is ``share`` of the other."""
    gap = rows.withColumn("_g", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(value)))
    out = gap.groupBy(key).agg(F.min("_g").alias("gap"), (F.max(value) - F.min(value)).alias("spread"))
    return out.withColumn("wide_enough", F.coalesce(F.col("gap") >= F.col("spread") * share, F.lit(True)))


def rescaled(rows: DataFrame, key: str, value: str, low: float, high: float) -> Column:
    """Min-max rescaling of ``value`` within its key to [low, high]."""
    w = Window.partitionBy(key)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - a) / F.greatest(b - a, F.lit(1e-9)) * (high - low) + low


def clipped(series: DataFrame, key: str, x: str, y: str, threshold: float) -> DataFrame:
    """Points of a polyline that are at or under ``threshold``, with exact crossings, as pieces.

    key, piece (from 0), x, y: a crossing ends one piece or begins another.
    """
    w = Window.partitionBy(key).orderBy(x)
    s = series.select(key, F.col(x).cast("double").alias("x"), F.col(y).alias("y"), F.lead(F.col(x).cast("double")).over(w).alias("nx"), F.lead(y).over(w).alias("ny"))
    t = F.lit(threshold)
    inside = F.col("y") <= t
    crosses = F.col("ny").isNotNull() & (inside != (F.col("ny") <= t))
    at = F.col("x") + (t - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))
    # A crossing out of the kept side ends a piece, one into it begins the next.
    own = F.when(inside, F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(0).alias("begins"))))
    cross = F.when(crosses, F.array(F.struct(at.alias("x"), t.alias("y"), F.when(inside, 0).otherwise(1).alias("begins"))))
    none = F.array().cast("array<struct<x:double,y:double,begins:int>>")
    points = s.select(key, F.explode(F.concat(F.coalesce(own, none), F.coalesce(cross, none))).alias("p")).select(key, "p.*")
    place = Window.partitionBy(key).orderBy("x", F.desc("begins")).rowsBetween(Window.unboundedPreceding, 0)
    begun = points.withColumn("piece", F.sum("begins").over(place))
    first = F.min("piece").over(Window.partitionBy(key))
    return begun.select(key, (F.col("piece") - first).cast("long").alias("piece"), "x", "y")
