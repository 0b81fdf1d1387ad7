"""Where problems come from: a folder tree, a Parquet dataset, or a named dataset at a revision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import problem_tree


@dataclass(frozen=True)
class Spec:
    kind: str
    name: str
    revision: str | None = None
    config: str | None = None
    split: str | None = None


def parse(spec: str, config: str | None = None, split: str | None = None) -> Spec:
    """``hf:<name>[@revision]``, ``parquet:<path>`` or the path of a tree."""
    if spec.startswith("hf:"):
        name, at, revision = spec[3:].partition("@")
        if not name:
            raise ValueError("the dataset's name is missing")
        if at and not revision:
            raise ValueError("the revision after @ is empty")
        if not config:
            raise ValueError("a dataset needs a configuration")
        return Spec("hf", name, revision or None, config, split)
    if spec.startswith("parquet:"):
        return Spec("parquet", spec[8:])
    return Spec("tree", spec)


def load(spark: SparkSession, spec: Spec, tasks: list[str] | None = None, mirror: str | None = None) -> DataFrame:
    """Problems of a spec; only the wanted tasks are read.

    A named dataset is read from ``mirror`` (a folder of Parquet files per name, revision,
    configuration and split), since there is no network here.
    """
    if spec.kind == "tree":
        rows = problem_tree.problems(spark, spec.name)
    else:
        if spec.kind == "hf" and not mirror:
            raise ValueError("a named dataset needs a local mirror")
        path = spec.name if spec.kind == "parquet" else "/".join(x for x in (mirror.rstrip("/"), spec.name, spec.revision, spec.config, spec.split) if x)
        rows = spark.read.parquet(path)
        if "metadata" in rows.columns and dict(rows.dtypes)["metadata"] == "string":
            rows = rows.withColumn("metadata", F.from_json("metadata", problem_tree.SIDECAR))
    if tasks:
        rows = rows.where(F.col("task").isin(tasks))
        if not rows.head(1):
            raise ValueError(f"no problem of the tasks {tasks}")
    return rows


def available(spark: SparkSession, root: str) -> DataFrame:
    """benchmark: the folders under ``root`` that have a ``problems.jsonl``, by name; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "problems.jsonl").load(f"{root}/*")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("benchmark")).distinct().orderBy("benchmark")
