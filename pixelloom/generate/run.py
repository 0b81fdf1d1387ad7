"""Problems as a relation: one task per seed row, so output doesn't depend on partitions or order."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import infer, scoring
from ..sources import png
from . import charts, tasks

MAX_ATTEMPTS = 200
#: Tasks from which on they get larger instead of more: to begin one takes as long as two or three problems, and the driver keeps track of each.
MOST_TASKS = 500


def seed_of(*parts) -> int:
    """48 bits of sha-256 over the parts; the same as the SQL expression for seeds."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def slots(spark: SparkSession, names: list[str] | None = None, conditions: list[str] | None = None, per_task: int = dims.PROBLEMS_PER_TASK) -> DataFrame:
    """task, visual_condition, mode, slot, idx, size and n of every problem to make."""
    rows = []
    for t, (_, modes) in dims.TASKS.items():
        if names and t not in names:
            continue
        for ci, (c, (w, h, palette, striped, level)) in enumerate(dims.CONDITIONS.items()):
            if conditions and c not in conditions:
                continue
            each = per_task // len(modes)
            rows += [(t, c, m, s, ci * per_task + mi * each + s, w, h, striped, dims.n_of(t, level)) for mi, m in enumerate(modes) for s in range(each)]
    return spark.createDataFrame(rows, "task string, visual_condition string, mode string, slot int, idx int, width int, height int, striped boolean, n int")


def slots_of(rows: DataFrame) -> DataFrame:
    """Slots of given problems (idx, task, mode, visual_condition; any others go along): one slot a row, its number is idx."""
    spark = rows.sparkSession
    sizes = [(t, c, w, h, striped, dims.n_of(t, level)) for t in dims.TASKS for c, (w, h, _, striped, level) in dims.CONDITIONS.items()]
    about = spark.createDataFrame(sizes, "task string, visual_condition string, width int, height int, striped boolean, n int")
    return rows.join(F.broadcast(about), ["task", "visual_condition"]).withColumn("slot", F.col("idx").cast("int"))  # 160 rows


def dealt(grid: DataFrame, each: int) -> DataFrame:
    """Dealt out to tasks of some ``each`` problems; a picture takes a tenth of a second and megabytes, so a task takes few, until there are MOST_TASKS."""
    n = grid.count()
    return grid.repartition(1 + n // max(each, n // MOST_TASKS))


def made(r: dict, benchmark: str, scale: float) -> tuple[tasks.Problem | None, int]:
    """The problem of a slot from the first of MAX_ATTEMPTS seeds that makes a valid one, and that seed."""
    for attempt in range(MAX_ATTEMPTS):
        seed = seed_of(benchmark, r["task"], r["visual_condition"], r["mode"], r["slot"], attempt)
        found = tasks.generate(r["task"], seed, r["n"], max(16, round(r["width"] * scale)), max(16, round(r["height"] * scale)), r["mode"], striped=r["striped"])
        if found:
            return found, seed
    return None, seed


def evaluated(grid: DataFrame, models: list[str], benchmark: str = "shapes", scale: float = 1.0, deadline_s: float = 120.0, pause_s: float = 2.0) -> DataFrame:
    """task, idx, mode, visual_condition, model, success, error and the scores of every model's output for every slot.

    A problem is made, run through all models and scored where it is made: pictures stay arrays in the worker and none is packed, stored
    or sent.  A model that fails is a row without output and with its error; a slot for which no valid problem is found has no rows.
    """
    for m in models:
        infer.create(m)
    schema = f"task string, idx int, mode string, visual_condition string, model string, success boolean, error string, {scoring.SCORE_FIELDS}"
    arrow = pa.schema([*((n, pa.int32() if n == "idx" else pa.string()) for n in ("task", "idx", "mode", "visual_condition", "model")), ("success", pa.bool_()), ("error", pa.string()), *scoring._ARROW])

    def run(batches):
        calls = {m: infer.create(m) for m in models}
        for b in batches:
            for r in b.to_pylist():
                found, _ = made(r, benchmark, scale)
                if not found:
                    continue
                rows, of = [], scoring.base(found.image, found.answer)
                for m, call in calls.items():
                    output, error = None, None
                    try:
                        output, _, _ = infer.unpacked(infer.tried(lambda call=call: call(found.image, found.instruction, found.answer), deadline_s, pause_s))
                    except Exception as e:  # reported in the row; nothing is hidden
                        error = str(e)
                    rows.append({k: r[k] for k in ("task", "idx", "mode", "visual_condition")} | {"model": m, "success": error is None, "error": error} | scoring.triplet_score(found.image, found.answer, output, of))
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return grid.mapInArrow(run, schema)


def problems(grid: DataFrame, benchmark: str = "shapes", scale: float = 1.0) -> DataFrame:
    """benchmark, task, idx, mode, visual_condition, seed, instruction, input, answer (PNG), meta (JSON).

    The first of MAX_ATTEMPTS seeds that makes a valid problem is taken; a slot without one has null images.
    """
    schema = "benchmark string, task string, idx int, mode string, visual_condition string, seed long, instruction string, input binary, answer binary, meta string"
    arrow = pa.schema([("benchmark", pa.string()), ("task", pa.string()), ("idx", pa.int32()), ("mode", pa.string()), ("visual_condition", pa.string()), ("seed", pa.int64()), ("instruction", pa.string()), ("input", pa.binary()), ("answer", pa.binary()), ("meta", pa.string())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                found, seed = made(r, benchmark, scale)
                own = {k: r[k] for k in ("task", "idx", "mode", "visual_condition")} | {"benchmark": benchmark, "seed": seed}
                if found:
                    meta = {"instruction": found.instruction} | found.meta | {"task": r["task"], "mode": r["mode"], "visual_condition": r["visual_condition"], "problem_id": r["idx"], "category": dims.TASKS.get(r["task"], (None,))[0]}
                    own |= {"instruction": found.instruction, "input": png.encode(found.image), "answer": png.encode(found.answer), "meta": json.dumps(meta)}
                yield pa.RecordBatch.from_pylist([{n: own.get(n) for n in arrow.names}], schema=arrow)

    return grid.mapInArrow(run, schema)


def preservation(made: DataFrame) -> DataFrame:
    """The diagnostic split: removal's inputs, which are also the answers."""
    return made.where("task = 'removal'").withColumn("task", F.lit("preservation")).withColumn("answer", F.col("input")).withColumn("instruction", F.lit("Leave the image as it is."))


def chart_slots(spark: SparkSession, per_task: int = 30) -> DataFrame:
    """idx, chart, edit of a whole benchmark."""
    kinds = F.array(*(F.struct(F.lit(c).alias("chart"), F.lit(e).alias("edit")) for c, es in dims.CHARTS.items() for e in es))
    return spark.range(per_task).select(F.col("id").cast("int").alias("idx"), F.explode(kinds).alias("t")).select("idx", "t.*")


def chart_problems(grid: DataFrame, benchmark: str = "charts") -> DataFrame:
    """benchmark, chart, task, idx, seed, instruction, before, after (JSON states) of slots (idx, chart, edit)."""
    schema = "benchmark string, chart string, task string, idx int, seed long, instruction string, before string, after string"

    def run(batches):
        for b in batches:
            rows = []
            for i, c, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                seed = seed_of(benchmark, c, e, i)
                g = charts.generate(c, e, seed)
                rows.append({"benchmark": benchmark, "chart": c, "task": f"{c}_{e}", "idx": i, "seed": seed, "instruction": g["instruction"], "before": json.dumps(g["before"]), "after": json.dumps(g["after"])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int32() if n == "idx" else pa.int64() if n == "seed" else pa.string()) for n in ("benchmark", "chart", "task", "idx", "seed", "instruction", "before", "after")]))

    return grid.select("idx", "chart", "edit").mapInArrow(run, schema)
