"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under ``spark.checkpoint.dir``; where that is unset (local master only) under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        key = id(spark.sparkContext)
        if key not in _own:
            _own[key] = tempfile.mkdtemp(prefix="pixelloom-")
            atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
        root = f"file://{_own[key]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what is needed several times is made once, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
