"""Mirrored layers, strokes, primitives, chart dressing and layered settings against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import dressing, layers, planning
from pixelloom.plans import q_layers


def mirrored(pixels, line, size):
    """Every pixel of the canvas mapped back, four neighbours blended; pixels: {(x, y): (r, g, b, mask)}."""
    ax, ay, bx, by = line
    dx, dy = bx - ax, by - ay
    out = {}
    for cx in range(size):
        for cy in range(size):
            t = ((cx + 0.5 - ax) * dx + (cy + 0.5 - ay) * dy) / (dx * dx + dy * dy)
            x, y = round(2 * (ax + t * dx) - cx - 0.5, 9), round(2 * (ay + t * dy) - cy - 0.5, 9)
            if not (0 <= x < size and 0 <= y < size):
                continue
            i, j = math.floor(x - 0.5), math.floor(y - 0.5)
            u, v = x - 0.5 - i, y - 0.5 - j
            edge = lambda k: max(0, min(size - 1, k))
            sums = [0.0] * 4
            for a, b, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)):
                for k, c in enumerate(pixels.get((edge(i + a), edge(j + b)), (0, 0, 0, 0))):
                    sums[k] += w * c
            value = tuple(math.floor(round(s, 6) + 0.5) for s in sums)
            if value[3]:
                out[cx, cy] = value
    return out


def test_mirrored_layers(spark):
    rng = random.Random(2)
    size, scenes, lines = 17, {}, {}
    for k in range(12):
        scenes[k] = {(x, y): (rng.randrange(256), rng.randrange(256), rng.randrange(256), 255) for x in range(rng.randrange(6), rng.randrange(8, 18)) for y in range(rng.randrange(6), rng.randrange(8, 18)) if 0 <= x < size and 0 <= y < size}
        lines[k] = (8.5, 0.0, 8.5, 9.0) if k == 0 else (0.0, 0.0, 5.0, 5.0) if k == 1 else tuple(rng.uniform(0, size) for _ in range(4))
    layer = spark.createDataFrame([(k, x, y, *c) for k, p in scenes.items() for (x, y), c in p.items()], "scene long, cx int, cy int, r int, g int, b int, mask int")
    line = spark.createDataFrame([(k, *v) for k, v in lines.items()], "scene long, ax double, ay double, bx double, by double")
    got = {}
    for r in layers.reflected(layer, line, size).collect():
        got.setdefault(r["scene"], {})[r["cx"], r["cy"]] = (r["r"], r["g"], r["b"], r["mask"])
    for k in scenes:
        assert got.get(k, {}) == mirrored(scenes[k], lines[k], size), k
    assert got[0] == {(16 - x, y): c for (x, y), c in scenes[0].items()}, "a mirror between pixels moves them whole"
    assert got[1] == {(y, x): c for (x, y), c in scenes[1].items()}
    assert layers.reflected(layer.limit(0), line, size).count() == 0


def test_turned_layers(spark):
    rng = random.Random(7)
    size, layer, turns = 15, {}, {}
    for k in range(14):
        layer[k] = {(x, y): rng.randrange(1000) for x in range(size) for y in range(size) if rng.random() < 0.4}
        turns[k] = (90.0 * k, size / 2, size / 2) if k < 5 else (rng.uniform(-400, 400), rng.uniform(0, size), rng.uniform(0, size))
    df = spark.createDataFrame([(k, x, y, v) for k, p in layer.items() for (x, y), v in p.items()], "scene long, cx int, cy int, v int")
    t = spark.createDataFrame([(k, *v) for k, v in turns.items()], "scene long, degrees double, ox double, oy double")
    got = {}
    for r in layers.rotated(df, t, size, ["v"]).collect():
        got.setdefault(r["scene"], {})[r["cx"], r["cy"]] = r["v"]
    for k, (degrees, ox, oy) in turns.items():
        a, want = math.radians(degrees), {}
        for x in range(size):
            for y in range(size):
                dx, dy = x + 0.5 - ox, y + 0.5 - oy
                at = (math.floor(round(ox + dx * math.cos(a) - dy * math.sin(a), 9)), math.floor(round(oy + dx * math.sin(a) + dy * math.cos(a), 9)))
                if at in layer[k]:
                    want[x, y] = layer[k][at]
        assert got.get(k, {}) == want, k
    assert got[0] == layer[0] and got[3] == {(size - 1 - y, x): v for (x, y), v in layer[3].items()}, "no turn, and three quarters of one, move pixels whole"


def test_strokes_look_only_beside_their_segments(spark):
    rng = random.Random(5)
    segs = [(rng.randrange(3), *(rng.uniform(-30, 140) for _ in range(4))) for _ in range(30)] + [(3, 10.0, 50.0, 90.0, 50.0), (3, 50.0, 5.0, 50.0, 95.0), (4, 33.0, 33.0, 33.0, 33.0)]
    df = spark.createDataFrame(segs, "g int, ax double, ay double, bx double, by double")
    for width, step, cells in ((6.0, 4, 27), (11.0, 4, 27), (3.0, 1, 100)):
        got = {(r["g"], r["cx"], r["cy"]): round(r["d"], 6) for r in layers.stroked(df, ["g"], width, step=step, cells=cells).collect()}
        want = {}
        for g, ax, ay, bx, by in segs:
            for cx in range(cells):
                for cy in range(cells):
                    x, y, dx, dy = cx * step + step / 2, cy * step + step / 2, bx - ax, by - ay
                    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                    d = math.hypot(x - ax - t * dx, y - ay - t * dy)
                    if d <= width / 2:
                        want[g, cx, cy] = min(round(d, 6), want.get((g, cx, cy), 99))
        assert got == want
    assert layers.stroked(df.limit(0), ["g"], 3.0, step=1, cells=9).count() == 0


def test_no_plan_makes_whole_canvases(spark, sf_dir):
    for q in (q_layers.polygon_outline, q_layers.legend_strip, q_layers.reflect_layer):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))


def test_primitives(spark):
    rows = [("a", 0, "rect", 2, 3, 6, 5, 0, "w"), ("a", 1, "frame", 2, 3, 6, 7, 1, "k"), ("a", 2, "line", 0, 9, 9, 9, 2, "x"), ("b", 0, "arrow_h", 0, 0, 10, 10, 0, "k"), ("c", 0, "arrow_v", 0, 0, 10, 10, 0, "k"), ("d", 0, "rect", -5, -5, 1, 1, 0, "w"), ("d", 1, "other", 0, 0, 9, 9, 1, "z")]
    df = spark.createDataFrame([(k, o, kind, *map(float, v), c) for k, o, kind, *v, c in rows], "k string, " + layers.PRIMITIVE)
    got = {}
    for r in layers.rasterised(df, "k", 10, 10).collect():
        got.setdefault(r["k"], {})[r["px"], r["py"]] = r["color"]
    frame = {(x, y): "k" for x in range(2, 7) for y in range(3, 8) if x in (2, 6) or y in (3, 7)}
    assert got["a"] == {(x, y): "w" for x in range(3, 6) for y in (4, 5)} | frame | {(x, y): "x" for x in range(10) for y in (8, 9)}
    arrow = {(x, y) for x in range(10) for y in range(10) if (abs(y + 0.5 - 5) <= 2 if x + 0.5 < 6 else abs(y + 0.5 - 5) <= (10 - x - 0.5) / 0.4 * 0.5)}
    assert set(got["b"]) == arrow and set(got["c"]) == {(y, x) for x, y in arrow}
    assert got["d"] == {(0, 0): "w", (0, 1): "w", (1, 0): "w", (1, 1): "w"}


@pytest.mark.parametrize("side", ["top", "bottom", "left", "right"])
def test_keys_stay_in_their_strip_and_apart(spark, side):
    df = spark.createDataFrame([("s", side, i, f"c{i}", None if i == 1 else f"t{i}") for i in range(4)] + [("one", side, 0, "c0", "t0")], "k string, side string, i int, source string, target string")
    strip = layers.key_strips(df, "k", width=200, height=120, strip=30)
    px = layers.rasterised(strip, "k", 200, 120).where("k = 's'").collect()
    along, across = ("px", "py") if side in ("top", "bottom") else ("py", "px")
    size = 200 if side in ("top", "bottom") else 120
    assert len(px) == size * 30 and {(r["px"], r["py"]) for r in px} == {(x, y) for x in range(200) for y in range(120) if {"top": y < 30, "bottom": y >= 90, "left": x < 30, "right": x >= 170}[side]}
    assert {r["color"] for r in px} == {"white", "black", "x", "c0", "c1", "c2", "c3", "t0", "t2", "t3"}
    middle = {c: sum(r[along] for r in px if r["color"] == c) / sum(r["color"] == c for r in px) for c in ("c0", "t0", "c2", "t2", "c3", "t3")}
    assert middle["c0"] < middle["t0"] < middle["c2"] < middle["t2"] < middle["c3"] < middle["t3"]
    assert abs((middle["c0"] + middle["t0"]) / 2 - size / 8) <= 1.5


def test_words_and_titles_differ_within_a_chart(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("chart"), F.floor(F.col("id") / 2).alias("i"))
    rows = df.select("chart", dressing.distinct_word(F.col("chart"), F.col("i")).alias("w"), dressing.title(F.col("chart"), F.col("i")).alias("t"), dressing.magnitude(F.col("i")).alias("m")).collect()
    for chart in (0, 1):
        own = [r for r in rows if r["chart"] == chart]
        assert len({r["w"] for r in own}) == len({r["t"] for r in own}) == 3000
    sizes = [len(r["w"]) for r in rows]
    assert all(850 < sizes.count(n) < 1150 for n in range(3, 9)) and all(r["w"].isalpha() and r["t"].startswith(r["w"]) for r in rows)
    words = [len(r["t"].split(" ")) for r in rows]
    assert all(1850 < words.count(n) < 2150 for n in (1, 2, 3))
    assert {r["m"] for r in rows} == {10.0**k for k in range(-3, 4)}


def test_layers_of_settings(spark):
    rows = [
        (1, "url", None, "global", "g"), (2, "url", "NB1", "variant", ""), (3, "url", "NB2", "variant", "v2"), (4, "url", "NB2", "argument", None), (5, "name", None, "default", "d"), (6, "name", "NB1", "argument", "a"),
        (7, "name", "NB2", "variant", None), (8, "name", "NB1", "variant", "v"), (9, "thoughts", "NB1", "variant", "No"), (10, "thoughts", "NB1", "variant", "TRUE"), (11, "thoughts", "NB2", "other", "x"), (12, "alone", None, "global", "g"),
        (13, "empty", "NB1", "variant", ""), (14, "empty", None, "default", ""), (15, "thoughts", "NB2", None, "y"),
    ]
    df = spark.createDataFrame(rows, "e int, name string, variant string, layer string, value string")
    got = {(r["name"], r["variant"]): (r["value"], r["layer"]) for r in planning.resolved(df, "e").collect()}
    assert got == {
        ("url", "NB1"): ("g", "global"), ("url", "NB2"): ("v2", "variant"), ("name", "NB1"): ("a", "argument"), ("name", "NB2"): ("d", "default"),
        ("thoughts", "NB1"): ("TRUE", "variant"), ("thoughts", "NB2"): (None, None), ("empty", "NB1"): (None, None),
    }
    assert [r[0] for r in spark.createDataFrame([("0",), ("False",), ("NO",), ("",), ("yes",), (None,)], "v string").select(planning.truth(F.col("v"))).collect()] == [False, False, False, False, True, None]
