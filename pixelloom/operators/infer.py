"""Models as plug-ins over a plan of problems.

A model is made once per task by its factory and called per row with (input image, instruction,
answer image); it returns an image, or (image, reasoning), or (image, reasoning, sidecars).  The
shipped ones are baselines; wrappers of real models register themselves the same way.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import TRANSIENT
from ..sources import png
from .scoring import _bgr

REGISTRY: dict[str, Callable[[], Callable]] = {}


def register(name: str) -> Callable:
    def add(factory: Callable[[], Callable]) -> Callable[[], Callable]:
        REGISTRY[name.lower()] = factory
        return factory

    return add


def create(name: str) -> Callable:
    """The model of a name, in any case."""
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name.lower()]()


@register("echo_input")
def _echo():
    return lambda image, instruction, answer: (image, f"kept as is: {instruction}")


@register("answer_oracle")
def _oracle():
    return lambda image, instruction, answer: answer


@register("noise")
def _noise():
    def noisy(image, instruction, answer):
        seed = zlib.crc32(instruction.encode())  # the same for a problem, wherever it is run
        words = np.random.default_rng(seed).bit_generator.random_raw(-(-image.size // 8))  # the bytes that integers(0, 256) takes one by one
        return words.astype("<u8").view(np.uint8)[: image.size].reshape(image.shape), None, {"_seed.txt": str(seed).encode()}

    return noisy


def unpacked(result) -> tuple[np.ndarray, str | None, dict[str, bytes]]:
    """Image, reasoning, sidecars of whatever a model returned."""
    if not isinstance(result, tuple):
        return result, None, {}
    image, reasoning, sidecars = (*result, None, None)[:3]
    return image, reasoning, dict(sidecars or {})


def tried(call: Callable, deadline_s: float, pause_s: float):
    """What ``call`` returns; a transient error is tried again after a pause until the deadline has passed."""
    end = time.monotonic() + deadline_s
    while True:
        try:
            return call()
        except Exception as e:
            if not any(m in str(e).lower() for m in TRANSIENT) or time.monotonic() + pause_s > end:
                raise
            time.sleep(pause_s)


def run(plan: DataFrame, model: str, keys: list[str], deadline_s: float = 120.0, pause_s: float = 2.0) -> DataFrame:
    """keys, model, output (PNG), reasoning, sidecars, success, error, inference_time_s: one row per planned problem.

    A failing problem is a row with its error; the others go on.  Transient errors are tried again for ``deadline_s``.
    """
    create(model)
    types = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "model string, output binary, reasoning string, sidecars map<string, binary>, success boolean, error string, inference_time_s double"])
    arrow = pa.schema([("model", pa.string()), ("output", pa.binary()), ("reasoning", pa.string()), ("sidecars", pa.map_(pa.string(), pa.binary())), ("success", pa.bool_()), ("error", pa.string()), ("inference_time_s", pa.float64())])

    def go(batches):
        call = create(model)
        for b in batches:
            rows = []
            for r in b.select(["input", "answer", "instruction"]).to_pylist():
                began = time.perf_counter()
                try:
                    image, reasoning, sidecars = unpacked(tried(lambda: call(_bgr(r["input"]), r["instruction"], _bgr(r["answer"]) if r["answer"] else None), deadline_s, pause_s))
                    rows.append({"model": model, "output": png.encode(image), "reasoning": reasoning, "sidecars": list(sidecars.items()), "success": True, "error": None, "inference_time_s": time.perf_counter() - began})
                except Exception as e:  # reported in the row; nothing is hidden
                    rows.append({"model": model, "output": None, "reasoning": None, "sidecars": [], "success": False, "error": str(e), "inference_time_s": None})
            made = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), *made.columns], names=[*keys, *made.schema.names])

    return plan.select(*keys, "input", "answer", "instruction").mapInArrow(go, schema)


def incremental(plan: DataFrame, outputs: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """``run`` for problems without a usable output; the others' outputs are handed on as ``skipped`` rows without a time.

    ``outputs``: keys and output (image struct); one that is null or couldn't be decoded counts as missing.
    """
    usable = outputs.where(F.coalesce(F.col("output")["height"], F.lit(0)) > 0)
    new = run(plan.join(usable.select(*keys), keys, "left_anti"), model, keys).withColumn("skipped", F.lit(False))
    types = {f.name: f.dataType.simpleString() for f in usable.select(*keys).schema.fields}

    def pack(batches):
        for b in batches:
            data = [png.encode(_bgr(r)) for r in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(data, pa.binary())], names=[*keys, "output"])

    kept = usable.join(plan.select(*keys), keys, "left_semi").select(*keys, "output").mapInArrow(pack, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "output binary"]))
    missing = {f.name: f.dataType for f in new.schema.fields}
    known = {"model": F.lit(model), "output": F.col("output"), "success": F.lit(True), "skipped": F.lit(True)}
    return new.unionByName(kept.select(*keys, *(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in missing.items() if c not in keys)))
