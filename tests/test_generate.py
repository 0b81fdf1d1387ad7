from __future__ import annotations

import json
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import dims
from pixelloom.functions import text
from pixelloom.generate import canvas, charts, run, tasks
from pixelloom.sources import png


def test_every_task_has_a_generator():
    assert set(dims.TASKS) | {"preservation"} == set(tasks.TASKS)
    assert {c: tuple(charts.STATES) for c in ()} == {} and set(charts.STATES) == set(dims.CHARTS)


@pytest.mark.parametrize("name", sorted(tasks.TASKS))
@pytest.mark.parametrize("seed", [42, 123])
def test_problems_are_deterministic_and_valid(name, seed):
    for mode in dims.TASKS.get(name, (None, ("default",)))[1]:
        made = [next(p for k in range(50) if (p := tasks.generate(name, seed + k, 4, 96, 80, mode))) for _ in range(2)]
        a, b = made
        assert (a.image == b.image).all() and (a.answer == b.answer).all() and a.instruction == b.instruction
        assert a.image.shape == (80, 96, 3) == a.answer.shape and a.image.dtype == a.answer.dtype == np.uint8
        assert a.valid != (name == "preservation")
        json.dumps(a.meta)


def test_polygons_are_exact():
    square = np.array([(2.0, 3.0), (6.0, 3.0), (6.0, 9.0), (2.0, 9.0)])
    m = canvas.polygon_mask(square, 12, 12)
    assert m.sum() == 24 and m[3:9, 2:6].all()
    s = canvas.Shape("ring", 0, 0, 40, 40, 0, "red")
    ring, full = canvas.shape_mask(s, 40, 40).sum(), canvas.polygon_mask(s.points(), 40, 40).sum()
    assert ring / full == pytest.approx(1 - canvas.RING**2, abs=0.03)


def test_removal_and_recolor_edit_what_they_say():
    p = next(x for k in range(50) if (x := tasks.generate("removal", k, 6, 128, 128, "attribute")))
    gone = (p.image != p.answer).any(-1)
    assert gone.any() and not gone.all()
    scene = canvas.random_scene(Random(3), 5, 128, 128)
    assert len(scene.shapes) == 5 and all(s.fill not in scene.background for s in scene.shapes)


def test_grid_on_spark_does_not_depend_on_partitions(spark):
    grid = run.slots(spark, ["translation", "removal", "point_operations"], ["baseline", "striped"])
    assert grid.count() == 3 * 2 * 12
    a = {(r["task"], r["idx"]): r for r in run.problems(grid.repartition(1), scale=0.06).collect()}
    b = {(r["task"], r["idx"]): r for r in run.problems(grid.repartition(5), scale=0.06).collect()}
    assert a == b and all(r["input"] is not None for r in a.values())
    assert png.decode(bytes(a[("removal", 0)]["input"])).shape == (61, 61, 3)
    d = run.preservation(run.problems(grid.where("task = 'removal'").limit(2), scale=0.06)).collect()
    assert all(r["input"] == r["answer"] for r in d)


def test_seeds_equal_the_sql_form(spark):
    got = spark.range(1).select(text.sha_seed(F.lit("shapes"), F.lit("removal"), F.lit(3))).first()[0]
    assert got == run.seed_of("shapes", "removal", 3)


@pytest.mark.parametrize(("chart", "edit"), [(c, e) for c, es in dims.CHARTS.items() for e in es])
def test_chart_edits(chart, edit):
    for seed in (1, 2, 3):
        g = charts.generate(chart, edit, seed)
        assert g["before"] != g["after"] or edit in ("sort_bars", "add_cell", "shift_heatmap") and g["instruction"]
        assert g == charts.generate(chart, edit, seed)
        if edit == "remove_node":
            n = len(g["after"]["nodes"])
            assert n == len(g["before"]["nodes"]) - 1 and all(0 <= v < n for e in g["after"]["edges"] for v in e)
        if edit == "sort_bars":
            v = g["after"]["values"]
            assert v in (sorted(v), sorted(v, reverse=True))
    with pytest.raises(ValueError, match="no edit"):
        charts.generate("heatmap", "sort_bars", 1)


def test_chart_problems(spark):
    got = run.chart_problems(run.chart_slots(spark, 3))
    assert got.count() == 60 and got.select("task").distinct().count() == 20


def test_registered_queries_read_their_table_at_full_size(spark, sf_dir, monkeypatch):
    """One problem a condition of the suppliers', scored in the pass that makes it as its packed pictures are on their own."""
    from pixelloom.operators import infer, scoring
    from pixelloom.plans import q_generate
    from pixelloom.sources import png

    grid, scales, evaluated, problems = q_generate._grid(spark, sf_dir), [], run.evaluated, run.problems
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert grid.count() == suppliers
    wide = spark.createDataFrame([(i, "removal", "location", c) for i, c in enumerate(dims.CONDITIONS)], "idx int, task string, mode string, visual_condition string")
    monkeypatch.setattr(q_generate, "_grid", lambda spark, sf_dir: run.slots_of(wide))
    monkeypatch.setattr(run, "evaluated", lambda g, m, **o: (scales.append(o["scale"]), evaluated(g, m, **o))[1])
    monkeypatch.setattr(run, "problems", lambda g, **o: (scales.append(o["scale"]), problems(g, **o))[1])
    got = {(r["model"], r["idx"]): r for r in q_generate.image_scores(spark, sf_dir).collect()}
    assert len(got) == 24 and scales == [1.0]
    for r in problems(run.slots_of(wide)).collect():
        image, answer = png.decode(r["input"]), png.decode(r["answer"])
        assert image.shape[1::-1] == dims.CONDITIONS[r["visual_condition"]][:2]
        for m in q_generate.MODELS:
            want = scoring.triplet_score(image, answer, infer.unpacked(infer.create(m)(image, r["instruction"], answer))[0])
            own = got[m, r["idx"]]
            assert (own["edit_pixels"], own["iou"], own["correct_output_size"]) == (want["edit_pixels"], want["blocks"][2]["iou"], True)
    assert q_generate.generate_problems(spark, sf_dir).count() == q_generate.generate_preservation(spark, sf_dir).count() == 8


def plain_mask(points, width, height):
    """One edge after the other, over the whole canvas."""
    cx, cy, inside = np.arange(width) + 0.5, np.arange(height) + 0.5, np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0)):
        rows = (ay > cy) != (by > cy)
        if rows.any():
            inside[rows] ^= cx[None, :] < (ax + (cy[rows] - ay) / (by - ay) * (bx - ax))[:, None]
    return inside


def test_masks_and_pictures_equal_plain_ones():
    rng = Random(8)
    for name in canvas.POLYGONS:
        for _ in range(6):  # some of them partly or wholly outside, some under a pixel
            w, h = rng.uniform(0.2, 60), rng.uniform(0.2, 60)
            p = canvas.Shape(name, rng.uniform(-40, 70), rng.uniform(-40, 60), w, h, rng.choice([0, 15, 90]), "red").points()
            assert (canvas.polygon_mask(p, 64, 48) == plain_mask(p, 64, 48)).all()
    for striped in (False, True):
        scene = canvas.random_scene(Random(4), 9, 96, 64, striped=striped)
        want = np.empty((64, 96, 3), np.uint8)
        y, x = np.mgrid[:64, :96]
        d = (x - 48) * np.cos(np.radians(scene.angle)) + (y - 32) * np.sin(np.radians(scene.angle))
        want[:] = np.array([scene.colors[c] for c in scene.background], np.uint8)[np.floor(d / (scene.band * 96)).astype(int) % len(scene.background)]
        for s in scene.shapes:
            want[canvas.shape_mask(s, 96, 64)] = scene.colors[s.fill]
        assert (scene.draw() == want).all()


def test_border_is_as_wide_everywhere_as_on_a_whole_canvas():
    for seed in range(12):
        p = tasks.generate("border", seed, 3, 130, 90)
        own = canvas.random_scene(Random(seed), 3, 130, 90)
        k = tasks.chosen(Random(seed ^ 0x5EED), own)
        m, r = canvas.shape_mask(own.shapes[k], 130, 90), p.meta["radius"]
        y, x = np.nonzero(m)
        gy, gx = np.mgrid[:90, :130]
        wide = np.zeros_like(m)
        for a, b in zip(y, x):
            wide |= (gy - a) ** 2 + (gx - b) ** 2 <= r * r
        image = own.draw()
        changed = (p.image != p.answer).any(-1)
        assert (p.image == image).all() and (changed == (wide & ~m & changed)).all()
        ink = p.answer[changed][0]
        assert (p.answer[wide & ~m] == ink).all()


def test_a_picture_takes_one_byte_a_pixel_until_it_is_done():
    import tracemalloc

    scene = canvas.random_scene(Random(1), 25, 1024, 1024, striped=True)
    tracemalloc.start()
    scene.draw()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20


def test_shapes_are_filled_once_a_problem(monkeypatch):
    """Input and answer share masks and pictures; what an edit gets is its own."""
    filled, box = [], canvas.shape_box
    monkeypatch.setattr(canvas, "shape_box", lambda s, *a: (filled.append(s), box(s, *a))[1])
    scene = canvas.random_scene(Random(7), 12, 200, 160)
    image = scene.draw()
    image[:] = 0
    less = scene.draw(scene.shapes[:-1])
    assert len(filled) == 12 and scene.draw().any()
    plain = canvas.Scene(200, 160, scene.colors, scene.background, scene.shapes[:-1])
    assert (less == plain.draw()).all() and (scene.draw() == canvas.painted(scene.canvas(), scene.tones)).all()


def test_tasks_get_larger_and_not_more(spark, monkeypatch):
    monkeypatch.setattr(run, "MOST_TASKS", 10)
    assert [run.dealt(spark.range(n), 4).rdd.getNumPartitions() for n in (3, 39, 400, 1000)] == [1, 10, 11, 11]
