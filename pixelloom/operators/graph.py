"""Edits of small undirected graphs given as nodes and edges (i < j)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbour: both directions of every edge."""
    return edges.select(F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("neighbour")), F.struct(F.col("j").alias("node"), F.col("i").alias("neighbour")))).alias("e")).select("e.*")


def without(edges: DataFrame, gone: Column) -> DataFrame:
    """Edges whose both ends stay; ``gone`` tells of the column ``node``."""
    ends = neighbours(edges).where(gone).select(F.least("node", "neighbour").alias("i"), F.greatest("node", "neighbour").alias("j")).distinct()
    return edges.join(ends, ["i", "j"], "left_anti")


def swapped(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Edges after nodes a and b change places."""
    move = lambda c: F.when(F.col(c) == a, b).when(F.col(c) == b, a).otherwise(F.col(c)).cast("int")
    return edges.select(F.least(move("i"), move("j")).alias("i"), F.greatest(move("i"), move("j")).alias("j"))
