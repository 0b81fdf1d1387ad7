from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import infer, planning, scoring
from pixelloom.sources import benchmark, jsonl, png, problem_tree, sinks
from pixelloom.streaming import incremental


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(0)
    rows = []
    for task in ("removal", "recolor"):
        for k in range(3):
            i = rng.integers(0, 256, (10, 14, 3), np.uint8)
            a = i.copy()
            a[:3] = 255 - a[:3]
            rows.append(("bench", task, k, bytearray(png.encode(i)), bytearray(png.encode(a)), f'{{"instruction": "{task} {k}", "problem_id": {k}, "mode": "default"}}'))
    d = spark.createDataFrame(rows, "benchmark string, task string, idx int, input binary, answer binary, meta string")
    assert sinks.write_problems(d, f"file://{root}/p").count() == 6
    return root


def test_models_outputs_and_scores_end_to_end(spark, tree):
    probs = benchmark.load(spark, benchmark.parse(f"file://{tree}/p"))
    keys = ["benchmark", "task", "idx"]
    for name in ("answer_oracle", "echo_input", "noise"):
        out = infer.run(probs, name.upper() if name == "noise" else name, keys)
        assert sinks.write_outputs(out.withColumn("model", F.lit(name)), f"file://{tree}/o").count() == 6
    outs = problem_tree.outputs(spark, f"file://{tree}/o")
    assert outs.count() == 18 and len(list(tree.glob("o/noise/*/*/*_seed.txt"))) == 6 and len(list(tree.glob("o/echo_input/*/*/*_output.txt"))) == 6
    s = scoring.score_images(probs.join(outs, keys), ["model", *keys])
    by = {r["model"]: r["iou"] for r in s.groupBy("model").agg(F.avg(F.element_at("blocks", 1)["iou"]).alias("iou")).collect()}
    assert by["answer_oracle"] == 1 and by["echo_input"] == 0 and by["noise"] < 0.1
    nested = sinks.nested_records(s, ["model", "benchmark", "task", "idx"])
    sinks.write_records(nested, f"file://{tree}/stats", ["model", "benchmark", "task", "idx"])
    long = jsonl.long_form(jsonl.problem_stats(spark, f"file://{tree}/stats"), ["model", "task", "idx"])
    assert long.count() == 18 * 12 and long.where("model = 'answer_oracle' AND iou < 1").count() == 0
    pics = sinks.diff_pngs(probs.join(outs, keys).where("model = 'echo_input'"), keys).collect()
    assert len(pics) == 24 and all(tuple(png.decode(bytes(r["png"]))[0, 0]) == sinks.DIFF_COLORS["red"] for r in pics if r["kind"] == "diff_0")
    sinks.report_html(long.groupBy("model").agg(F.avg("iou").alias("iou")), f"file://{tree}/report.html")
    assert "answer_oracle" in (tree / "report.html").read_text()


def test_unknown_model_and_failures(spark, tree):
    with pytest.raises(ValueError, match="unknown"):
        infer.create("nope")

    infer.REGISTRY["broken"] = lambda: lambda *a: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            infer.create("broken")(None, None, None)
    finally:
        del infer.REGISTRY["broken"]
    assert infer.unpacked((1, "r", {"a": b"x"})) == (1, "r", {"a": b"x"}) and infer.unpacked(5) == (5, None, {})


def test_specs():
    assert benchmark.parse("hf:a/b@r1", config="c") == benchmark.Spec("hf", "a/b", "r1", "c", None)
    assert benchmark.parse("/data/x").kind == "tree"
    for bad in ("hf:", "hf:a/b@", "hf:@x"):
        with pytest.raises(ValueError):
            benchmark.parse(bad, config="c")
    with pytest.raises(ValueError, match="configuration"):
        benchmark.parse("hf:a/b")


def test_task_filter(spark, tree):
    spec = benchmark.parse(f"file://{tree}/p")
    assert benchmark.load(spark, spec, ["recolor"]).count() == 3
    with pytest.raises(ValueError, match="no problem"):
        benchmark.load(spark, spec, ["unknown"])


def test_jsonl_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"task": "a", "problem_id": 1}\n\nbroken\n{"task": "b", "problem_id": 2}\n')
    assert jsonl.manifest(spark, f"file://{tmp_path}/m.jsonl").count() == 2
    (tmp_path / "a.jsonl").write_text('{"model": "big-x", "level": "task"}\n{"model": "small", "level": "task"}\n')
    assert [r["model"] for r in jsonl.aggregate_stats(spark, f"file://{tmp_path}/a.jsonl", ["big"]).collect()] == ["small"]
    (tmp_path / "r.json").write_text('{"tasks": {"t": {"task_id": "t", "problems": [{"index": 0, "success": true}, {"index": 1, "success": false, "error": "HTTP 503"}]}}}')
    runs = jsonl.runs(spark, f"file://{tmp_path}/r.json")
    bad = planning.failed(runs).select("task", "idx", planning.is_transient(F.col("error")).alias("again")).collect()
    assert [tuple(r) for r in bad] == [("t", 1, True)]


@pytest.mark.parametrize(("sidecar", "length", "output", "marker", "fresh"), [(5, 10, 4, True, True), (None, 10, 4, True, False), (5, 0, 4, True, False), (5, 10, 6, True, False), (5, 10, None, True, True), (5, 10, 4, False, False)])
def test_freshness(spark, sidecar, length, output, marker, fresh):
    d = spark.createDataFrame([(1, 2, output, sidecar, length, marker)], "input_t int, answer_t int, output_t int, sidecar_t int, sidecar_len int, marker boolean")
    assert bool(d.select(planning.is_fresh()).first()[0]) is fresh


def test_incremental_evaluation_is_idempotent(spark, tmp_path):
    root = tmp_path / "o"

    def put(model, idx, value, when):
        f = root / model / "bench" / "removal" / f"{idx:04d}_output.png"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(png.encode(np.full((2, 2, 3), value, np.uint8)))
        os.utime(f, (when, when))

    def go():
        q = incremental.evaluate(incremental.output_stream(spark, f"file://{root}"), f"file://{tmp_path}/t", f"file://{tmp_path}/c", lambda d: d.drop("content"))
        q.awaitTermination(60)
        incremental.refresh(spark, f"file://{root}", f"file://{tmp_path}/t", lambda d: d.drop("content"))
        return {(r["model"], r["idx"]): r["time"].timestamp() for r in incremental.current(spark, f"file://{tmp_path}/t").collect()}

    now = int(time.time()) - 1000
    put("m", 0, 1, now), put("m", 1, 2, now)
    assert len(go()) == 2
    put("m", 1, 3, now + 50), put("n", 0, 3, now + 60)
    again = go()
    assert len(again) == 3 and again[("m", 1)] == now + 50 and again[("m", 0)] == now
    assert go() == again


def test_windows_over_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = incremental.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour")
    assert w.agg(F.sum("n")).first()[0] == e.count()


def test_outputs_that_exist_are_skipped(spark, tree):
    """Problems with a usable picture aren't run again and have no time; a broken or missing one is made."""
    probs = benchmark.load(spark, benchmark.parse(f"file://{tree}/p"))
    keys = ["benchmark", "task", "idx"]
    outs = probs.select(*keys, F.when(F.col("idx") == 0, F.col("answer")).when(F.col("idx") == 1, F.struct(*(F.lit(None if f != "height" else -1).cast(probs.schema["answer"].dataType[f].dataType).alias(f) for f in probs.schema["answer"].dataType.names))).alias("output")).where("idx < 2")
    got = infer.incremental(probs, outs, "echo_input", keys).collect()
    assert len(got) == 6 and all(r["success"] for r in got)
    assert {r["idx"] for r in got if r["skipped"]} == {0} and all((r["inference_time_s"] is None) == r["skipped"] for r in got)
    want = {(r["task"], r["idx"]): r for r in probs.collect()}
    for r in got:
        pic = want[r["task"], r["idx"]]["answer" if r["skipped"] else "input"]
        assert (png.decode(bytes(r["output"])) == scoring._bgr(pic.asDict())).all()


def test_transient_errors_are_tried_until_the_deadline():
    calls = []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 service unavailable")
        return "ok"

    assert infer.tried(shaky, 5, 0.01) == "ok" and len(calls) == 3
    with pytest.raises(RuntimeError, match="rate limit"):
        infer.tried(lambda: (_ for _ in ()).throw(RuntimeError("rate limit")), 0.05, 0.02)
    calls.clear()
    with pytest.raises(ValueError, match="bad prompt"):
        infer.tried(lambda: (calls.append(1), (_ for _ in ()).throw(ValueError("bad prompt"))), 5, 0.01)
    assert len(calls) == 1


def test_available_benchmarks_and_reported_metrics(spark, tmp_path):
    for name in ("shapes", "charts", "empty"):
        (tmp_path / name).mkdir()
        if name != "empty":
            (tmp_path / name / "problems.jsonl").write_text("{}")
    assert [r[0] for r in benchmark.available(spark, f"file://{tmp_path}").collect()] == ["charts", "shapes"]
    rows = spark.sql("SELECT 'm' model, named_struct('num_problems', 3, 'iou_mean', 0.5D, 'iou_std', 0.1D, 'changed_pixels_mean', 7D) block")
    assert sinks.report_metrics(rows, ["model"]).first().asDict() == {"model": "m", "num_problems": 3, "iou_mean": 0.5, "iou_std": 0.1}


def test_a_writer_makes_each_folder_once(tmp_path, monkeypatch):
    from pixelloom.sources import sinks

    class Counted:
        made = 0

        def __init__(self, fs):
            self.fs = fs

        def create_dir(self, *args, **how):
            Counted.made += 1
            return self.fs.create_dir(*args, **how)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    fs, base = sinks.pafs.FileSystem.from_uri(f"file://{tmp_path}")
    monkeypatch.setattr(sinks, "pafs", type("pafs", (), {"FileSystem": type("FileSystem", (), {"from_uri": staticmethod(lambda root: (Counted(fs), base))})}))
    put = sinks.writer(f"file://{tmp_path}")
    for k in range(30):
        put(f"{'ab'[k % 2]}/{k}", bytes([k]))
    assert Counted.made == 2
    assert {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {f"{'ab'[k % 2]}/{k}": bytes([k]) for k in range(30)}


def test_index_of_a_tree_is_made_without_a_list_of_files_on_the_driver(spark, tree, tmp_path):
    """The same rows as by Spark's image reader: a missing and a damaged picture, a broken sidecar, hidden files and deeper folders among them."""
    import shutil

    root = tmp_path / "p"
    shutil.copytree(tree / "p", root)
    shutil.copytree(root / "bench" / "removal", root / "bench" / "deep" / "er" / "border")
    shutil.copytree(root / "bench" / "removal", root / "bench" / "_hidden")
    at = root / "bench" / "removal"
    (at / "001_answer.png").unlink()
    (at / "002_input.png").write_bytes(b"no picture")
    (at / ".003_input.png").write_bytes(b"x")
    (root / "bench" / "recolor" / "000.json").write_text("{broken")
    (root / "bench" / "recolor" / "notes.json").write_text("{}")
    got = problem_tree.index(spark, f"file://{root}")
    plain = problem_tree.problems(spark, f"file://{root}")
    want = plain.select("benchmark", "task", "idx", "problem_id", "instruction", F.col("input.height").alias("height"), F.col("input.width").alias("width"), F.col("answer").isNotNull().alias("has_answer"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    assert sorted(got.select("height", "has_answer").where("task = 'removal'").collect()) == [(-1, True), (10, False), (10, True)]
    for name in (got, problem_tree.demo_index(spark)):
        plan = name._jdf.queryExecution().executedPlan().toString()
        assert "image" not in plan and "binaryFile" not in plan and not any(f.endswith((".png", ".json")) for f in name.inputFiles())
