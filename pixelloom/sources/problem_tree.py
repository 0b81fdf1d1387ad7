"""Problem trees and output trees on disk: images by Spark's image source, sidecars as JSON.

Layout: ``<root>/<benchmark>/<task>/NNN_input.png, NNN_answer.png, NNN.json`` and
``<root>/<model>/<benchmark>/<task>/NNNN_output.png``.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import png, shared, sinks

#: Files of a kind that a task reads.
READ = 1_000
SIDECAR = "instruction string, category string, task string, mode string, visual_condition string, problem_id long, seed long, n int, W int, H int, bg_color string, bg_colors array<string>"


def _images(spark: SparkSession, root: str, kind: str) -> DataFrame:
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{kind}.png").option("dropInvalid", False).load(root)
    path = F.col("image.origin")
    return rows.select(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("benchmark"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_extract(path, rf"(\d+)_{kind}\.png$", 1).cast("long").alias("idx"), F.col("image").alias(kind))


def _keys(path: Column, end: str) -> list[Column]:
    """benchmark, task and idx that a path names (idx: null if it doesn't)."""
    return [F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("benchmark"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_extract(path, rf"(\d+){end}$", 1).try_cast("long").alias("idx")]


def _sidecars(text: DataFrame) -> DataFrame:
    """benchmark, task, idx, m of the sidecars (path, content) that parse."""
    return text.select(*_keys(F.col("path"), r"\.json"), F.from_json(F.col("content").cast("string"), SIDECAR).alias("m")).where(F.col("idx").isNotNull() & F.col("m.instruction").isNotNull())


def problems(spark: SparkSession, root: str) -> DataFrame:
    """benchmark, task, idx, problem_id, sidecar columns, input, answer (null if missing).

    A problem whose sidecar is missing or doesn't parse is left out.
    """
    text = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    meta, keys = _sidecars(text), ["benchmark", "task", "idx"]
    out = _images(spark, root, "input").join(meta, keys).join(_images(spark, root, "answer"), keys, "left")
    return out.select(*keys, F.coalesce("m.problem_id", "idx").alias("problem_id"), *(f"m.{c}" for c in ("instruction", "category", "mode", "visual_condition", "seed", "bg_colors")), "input", "answer")


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """model, benchmark, task, idx, output."""
    rows = _images(spark, root, "output")
    return rows.select(F.regexp_extract("output.origin", r"([^/]+)/[^/]+/[^/]+/[^/]+$", 1).alias("model"), "benchmark", "task", "idx", "output")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path of every file under ``root``, in a store that pyarrow opens; hidden ones are left out, as Spark's readers do.

    Folders are listed in tasks, and only their names come to the driver: Spark's readers would keep every file there.
    """

    def listed(kind: pafs.FileType):
        def run(batches):
            fs, base = pafs.FileSystem.from_uri(root)
            for b in batches:
                for folder in b.column(0).to_pylist():
                    found = [x.path for x in fs.get_file_info(pafs.FileSelector(folder or base)) if x.type == kind and not x.base_name.startswith(("_", "."))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

        return run

    rows = lambda folders: spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders))
    new = known = [""]
    while new:
        new = [r["path"] for r in rows(new).mapInArrow(listed(pafs.FileType.Directory), "path string").toLocalIterator()]
        known = known + new
    return rows(known).mapInArrow(listed(pafs.FileType.File), "path string")


def index(spark: SparkSession, root: str) -> DataFrame:
    """benchmark, task, idx, problem_id, instruction, height, width, has_answer of a tree's problems, as ``problems`` finds them.

    Pictures are read and decoded whole, by tasks that know their names; only sizes go on.  A picture that can't be decoded has height and width -1.
    """
    names = shared.stored(files(spark, root), "names")
    parts = 1 + names.count() // (3 * READ)

    def read(end: str, fields: dict[str, tuple[str, pa.DataType]], of) -> DataFrame:
        arrow = pa.schema([("path", pa.string()), *((c, t) for c, (_, t) in fields.items())])

        def run(batches):
            fs, _ = pafs.FileSystem.from_uri(root)
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    rows = []
                    for path in b.column(0).slice(at, 100).to_pylist():
                        with fs.open_input_stream(path) as f:
                            rows.append({"path": path} | of(f.read()))
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return names.where(F.col("path").endswith(end)).repartition(parts).mapInArrow(run, ", ".join(["path string", *(f"{c} {t}" for c, (t, _) in fields.items())]))

    def sizes(data: bytes) -> dict:
        try:
            height, width = png.decode(data).shape[:2]
        except Exception:  # of whatever kind the damage is
            height = width = -1
        return {"height": height, "width": width}

    pictures = lambda kind: read(f"_{kind}.png", {c: ("int", pa.int32()) for c in ("height", "width")}, sizes).select(*_keys(F.col("path"), rf"_{kind}\.png"), "height", "width")
    meta, keys = _sidecars(read(".json", {"content": ("binary", pa.binary())}, lambda data: {"content": data})), ["benchmark", "task", "idx"]
    out = pictures("input").join(meta, keys).join(pictures("answer").select(*keys, F.lit(True).alias("has_answer")), keys, "left")
    return out.select(*keys, F.coalesce("m.problem_id", "idx").alias("problem_id"), F.col("m.instruction").alias("instruction"), "height", "width", F.coalesce("has_answer", F.lit(False)).alias("has_answer"))


def write_problem(folder: Path, idx: int, image: np.ndarray, answer: np.ndarray, meta: dict) -> None:
    root = f"file://{Path(folder).resolve()}"
    sinks.put(root, f"{idx:03d}_input.png", png.encode(image))
    sinks.put(root, f"{idx:03d}_answer.png", png.encode(answer))
    sinks.put(root, f"{idx:03d}.json", json.dumps(meta, indent=2).encode())


def demo_index(spark: SparkSession, grid: DataFrame | None = None, broken: str = "shapes/recolor/002.json") -> DataFrame:
    """Small pictures of a grid's problems, written as a tree to the shared folder and scanned; the sidecar ``broken`` doesn't parse.

    Without a grid, two tasks in two conditions are made.
    """
    from ..generate import run

    root = shared.new_path(spark, "tree")
    grid = run.slots(spark, ["removal", "recolor"], ["baseline", "striped"]).repartition(8) if grid is None else grid
    sinks.write_problems(run.problems(grid, scale=1 / 32).where("input IS NOT NULL"), root).count()
    sinks.put(root, broken, b"{broken")
    return index(spark, root)
