"""Writers: problem trees, model outputs, per-problem records, diff images, report data.

Image files are written by the tasks that hold the rows, through pyarrow's file systems, so any
store the executors share will do; each file is written under another name and renamed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import DIFF_THRESHOLDS
from ..functions.color import lab_array
from . import png

#: Colours of a diff image (changed and right, kept and right, changed and wrong, kept and wrong).
DIFF_COLORS = {"green": (0, 128, 0), "blue": (0, 0, 255), "red": (255, 0, 0), "orange": (255, 165, 0)}


def writer(root: str) -> Callable[[str, bytes], None]:
    """A function that puts files under ``root``; it opens the store once and makes each folder once."""
    fs, base = pafs.FileSystem.from_uri(root)
    made: set[str] = set()

    def put_file(name: str, data: bytes) -> None:
        path = f"{base}/{name}"
        folder = path.rsplit("/", 1)[0]
        if folder not in made:
            fs.create_dir(folder, recursive=True)
            made.add(folder)
        temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        with fs.open_output_stream(temp) as out:
            out.write(data)
        fs.move(temp, path)

    return put_file


def put(root: str, name: str, data: bytes) -> None:
    writer(root)(name, data)


def write_problems(problems: DataFrame, root: str) -> DataFrame:
    """Rows (benchmark, task, idx, input, answer as PNG bytes, meta as JSON text) to a tree; returns the written names."""

    def run(batches):
        put_file = writer(root)
        for b in batches:
            names = []
            for r in b.to_pylist():
                stem = f"{r['benchmark']}/{r['task']}/{r['idx']:03d}"
                put_file(f"{stem}_input.png", r["input"])
                put_file(f"{stem}_answer.png", r["answer"])
                put_file(f"{stem}.json", json.dumps(json.loads(r["meta"]), indent=2).encode())
                names.append(stem)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return problems.select("benchmark", "task", "idx", "input", "answer", "meta").mapInArrow(run, "name string")


def write_outputs(outputs: DataFrame, root: str) -> DataFrame:
    """Rows (model, benchmark, task, idx, output PNG bytes, reasoning, sidecars map) to a tree of outputs."""

    def run(batches):
        put_file = writer(root)
        for b in batches:
            names = []
            for r in b.to_pylist():
                stem = f"{r['model']}/{r['benchmark']}/{r['task']}/{r['idx']:04d}"
                put_file(f"{stem}_output.png", r["output"])
                if r["reasoning"]:
                    put_file(f"{stem}_output.txt", r["reasoning"].encode())
                for suffix, data in r["sidecars"] or []:
                    own = stem + suffix if suffix.startswith("_") else f"{stem}_output{suffix}" if suffix.startswith(".") else f"{stem}_output_{suffix}"
                    put_file(own, data)
                names.append(stem)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return outputs.select("model", "benchmark", "task", "idx", "output", "reasoning", "sidecars").mapInArrow(run, "name string")


def diff_image(image: np.ndarray, answer: np.ndarray, output: np.ndarray, threshold: float) -> np.ndarray:
    """Colour-coded picture of right and wrong pixels."""
    edit = np.any(image != answer, -1)
    right = np.sqrt(((lab_array(output) - lab_array(answer)) ** 2).sum(-1)) <= threshold
    out = np.empty(image.shape, np.uint8)
    for name, where in (("green", edit & right), ("blue", ~edit & right), ("red", edit & ~right), ("orange", ~edit & ~right)):
        out[where] = DIFF_COLORS[name]
    return out


def diff_pngs(triplets: DataFrame, keys: list[str], thresholds=DIFF_THRESHOLDS) -> DataFrame:
    """keys, threshold, png: diff images of triplets with outputs, and the fitted output where its size was wrong."""
    from ..operators.scoring import _bgr, fit_image

    types = {f.name: f.dataType.simpleString() for f in triplets.schema.fields}

    def run(batches):
        for b in batches:
            for k, r in enumerate(b.select(["input", "answer", "output"]).to_pylist()):
                if r["output"] is None or r["output"]["height"] <= 0:
                    continue
                image, answer, raw = _bgr(r["input"]), _bgr(r["answer"]), _bgr(r["output"])
                output = fit_image(raw, *answer.shape[:2])
                made = [(f"diff_{t}", png.encode(diff_image(image, answer, output, t))) for t in thresholds]
                if output.shape != raw.shape:
                    made.append(("normalized_output", png.encode(output)))
                own = [pa.array([b.column(b.schema.get_field_index(c))[k].as_py()] * len(made)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], names=[*keys, "kind", "png"])

    return triplets.select(*keys, "input", "answer", "output").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "kind string", "png binary"]))


def write_records(records: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines; the sort is global, the files are as many as partitions (in name order)."""
    records.orderBy(*order).write.mode("overwrite").json(path)


def _adder(field: str):
    return lambda acc, b: acc + b[field].cast("double")


def nested_records(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Scores (blocks arrays) in the nested form of the per-problem records."""
    fields = ("edit_correct_pixels", "preservation_correct_pixels", "edit_accuracy", "preservation_accuracy", "iou", "changed_pixels")
    blocks = F.map_from_entries(F.transform("blocks", lambda b: F.struct(b["t"].cast("string"), F.struct(*(b[f].cast("double").alias(f) for f in fields)))))
    mean = F.struct(*((F.aggregate("blocks", F.lit(0.0), _adder(f)) / F.size("blocks")).alias(f) for f in fields))
    return stats.select(*keys, "has_output", "correct_output_size", F.struct("edit_pixels", "preservation_pixels", blocks.alias("cie76_threshold"), mean.alias("cie76_mean")).alias("output"))


#: What a report shows of a block.
REPORTED = ("edit_accuracy", "preservation_accuracy", "iou")


def report_metrics(rows: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """keys, the count of problems and mean and deviation of the reported metrics, of rows with a ``block`` struct."""
    names = [f"{m}_{s}" for m in REPORTED for s in ("mean", "std")]
    have = rows.schema[block].dataType.names
    return rows.select(*keys, F.col(block)["num_problems"].alias("num_problems"), *(F.col(block)[n].alias(n) for n in names if n in have))


def report_html(rows: DataFrame, path: str, title: str = "Report") -> None:
    """A page with the report's rows as embedded JSON; a report has one row per level and model."""
    data = "[" + ",".join(r[0] for r in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator()) + "]"
    page = f"<!doctype html><meta charset='utf-8'><title>{title}</title><table id='t'></table><script>const rows={data.replace('</', '<' + chr(92) + '/')};const keys=Object.keys(rows[0]||{{}});t.innerHTML='<tr>'+keys.map(k=>'<th>'+k).join('')+rows.map(r=>'<tr>'+keys.map(k=>'<td>'+(r[k]??'—')).join('')).join('');</script>"
    root, _, name = path.rpartition("/")
    put(root, name, page.encode())
