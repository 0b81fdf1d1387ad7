"""Rejection waves, keyed draws, hulls, regions and control points against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import color, keyed
from pixelloom.operators import regions, sampling
from pixelloom.operators import scene as sc
from pixelloom.plans import derive


def wrapped(points):
    """Convex hull by definition: a corner is a point that is no convex combination of two or three others; ordered by angle."""
    pts = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    between = lambda p, a, b: turn(a, b, p) == 0 and min(a, b) < p < max(a, b)

    def inner(p):
        rest = [q for q in pts if q != p]
        if any(between(p, a, b) for a in rest for b in rest if a < b):
            return True
        return any(turn(a, b, c) != 0 and len({turn(a, b, p) > 0, turn(b, c, p) > 0, turn(c, a, p) > 0}) == 1 and 0 not in (turn(a, b, p), turn(b, c, p), turn(c, a, p)) for a in rest for b in rest if a < b for c in rest if b < c)

    corners = [p for p in pts if not inner(p)]
    low = corners[0]
    return [low, *sorted(corners[1:], key=lambda p: math.atan2(p[1] - low[1], p[0] - low[0]))]


def test_hulls_by_definition(spark):
    rng = random.Random(4)
    groups = [[(float(rng.randrange(w)), float(rng.randrange(w))) for _ in range(rng.randrange(1, 14))] for w in (2, 3, 6, 50) for _ in range(40)]
    groups += [[(1.0, 1.0)] * 5, [(0.0, 0.0), (2.0, 2.0), (1.0, 1.0)], [(3.0, 0.0), (3.0, 9.0), (3.0, 4.0), (3.0, 4.0)], [(0.0, 0.0), (1.0, 0.0)]]
    rows = [(k, x, y) for k, g in enumerate(groups) for x, y in g] + [(900, None, 1.0), (901, 1.0, 1.0), (901, None, None)]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(5)
    for pieces in (1, 16):
        got = {r["g"]: [(p["x"], p["y"]) for p in r["hull"]] for r in regions.hulls(df, "g", "x", "y", pieces).collect()}
        assert {k: got[k] for k in range(len(groups))} == {k: wrapped(g) for k, g in enumerate(groups)}
        assert got[901] == [(1.0, 1.0)] and 900 not in got
    assert regions.hulls(df.limit(0), "g", "x", "y").count() == 0


def test_a_hot_key_and_many_equal_points(spark):
    many = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") % 300).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    (row,) = regions.hulls(many, "g", "x", "y").collect()
    assert [(p["x"], p["y"]) for p in row["hull"]] == wrapped({(float(i % 300), float(i % 7)) for i in range(2100) if i % 300 in (0, 1, 298, 299)})


def test_spans_of_convex_polygons(spark):
    rng = random.Random(8)
    polys = [wrapped([(rng.uniform(-20, 130), rng.uniform(-20, 130)) for _ in range(7)]) for _ in range(60)] + [[(0.0, 0.0), (108.0, 0.0), (108.0, 108.0), (0.0, 108.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 1.5)], [(5.0, 5.0)], []]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate(polys)], f"k int, p {regions.POINTS}")
    got = {r["k"]: {(s["cy"], cx) for s in r["s"] for cx in range(s["lo"], s["hi"] + 1)} for r in df.select("k", regions.spans(F.col("p")).alias("s")).collect()}
    for k, p in enumerate(polys):
        inside = set()
        for cy in range(sc.CELLS):
            for cx in range(sc.CELLS):
                x, y = cx * sc.STEP + sc.STEP / 2, cy * sc.STEP + sc.STEP / 2
                n = sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]))
                if n % 2:
                    inside.add((cy, cx))
        assert got[k] == inside, k


def test_waves_make_only_the_attempts_needed(spark):
    made = []

    def advance(rows, lo, hi):
        made.append((lo, hi, rows.count()))
        return rows.withColumn("at", F.when((F.col("need") >= lo) & (F.col("need") < hi), F.col("need")).otherwise(F.col("at")))

    df = spark.createDataFrame([(k, n, -1) for k, n in enumerate([0, 1, 3, 3, 17, 40, 63, 64, 1000])], "k int, need int, at int")
    out = {r["k"]: r["at"] for r in sampling.in_waves(df, advance, F.col("at") < 0, first=4, limit=64).collect()}
    assert out == {0: 0, 1: 1, 2: 3, 3: 3, 4: 17, 5: 40, 6: 63, 7: -1, 8: -1}
    assert made == [(0, 4, 9), (4, 12, 5), (12, 28, 5), (28, 60, 4), (60, 64, 3)]
    made.clear()
    assert sampling.in_waves(df.where("need < 4"), advance, F.col("at") < 0, first=4, limit=64).count() == 4 and len(made) == 1
    assert sampling.in_waves(df.limit(0), advance, F.col("at") < 0, first=4, limit=64).count() == 0


def test_draws_are_those_of_the_hash(spark):
    row = spark.range(1).select(keyed.digest(F.lit("a"), F.lit(7)).alias("h")).select("h", *(keyed.share(F.col("h"), k).alias(f"u{k}") for k in range(keyed.PER_HASH))).first()
    h = hashlib.sha256(b"a|7").hexdigest()
    assert row["h"] == h and [row[f"u{k}"] for k in range(5)] == [int(h[12 * k : 12 * k + 12], 16) / 2**48 for k in range(5)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutations(spark, size):
    rows = spark.range(size * 3).select((F.col("id") % size).alias("i"), F.floor(F.col("id") / size).alias("k"))
    out = rows.select("k", "i", keyed.shuffled(F.col("i"), F.lit(size), F.col("k")).alias("p")).collect()
    by = {k: [r["p"] for r in sorted(out, key=lambda r: r["i"]) if r["k"] == k] for k in range(3)}
    assert all(sorted(v) == list(range(size)) for v in by.values())
    assert size < 16 or (by[0] != by[1] != by[2] and by[0] != list(range(size)))


def lab_of(r, g, b):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (r, g, b)]
    f = [(lambda t: math.cbrt(t) if t > (6 / 29) ** 3 else t * (29 / 6) ** 2 / 3 + 4 / 29)(sum(m * v for m, v in zip(row, lin)) / w) for row, w in zip(color.MATRIX, color.WHITE)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def test_palettes_keep_their_distance(spark):
    grounds = [(255, 0, 0), (0, 0, 0), (255, 255, 255), (40, 90, 200)]
    df = spark.createDataFrame([(f"s{k}", [dict(zip("lab", lab_of(*g)))]) for k, g in enumerate(grounds) for _ in range(1)], "k string, avoid array<struct<l:double,a:double,b:double>>")
    out = {r["k"]: r for r in sampling.palettes(df, "k", "avoid", n=6, apart=30.0, tries=400).collect()}
    assert len(out) == 4
    for k, g in enumerate(grounds):
        own = [lab_of(*g)] + [(c["l"], c["a"], c["b"]) for c in out[f"s{k}"]["chosen"]]
        assert len(own) == 7 and not out[f"s{k}"]["failed"]
        assert min(math.dist(a, b) for i, a in enumerate(own) for b in own[:i]) > 30.0
        for c in out[f"s{k}"]["chosen"]:
            assert math.dist((c["l"], c["a"], c["b"]), lab_of(c["red"], c["green"], c["blue"])) < 2.0
    crowded = {r["k"]: r for r in sampling.palettes(df, "k", "avoid", n=40, apart=60.0, tries=50).collect()}
    assert all(r["failed"] and 0 < len(r["chosen"]) < 40 for r in crowded.values())


def test_sources_are_drawn_evenly(spark):
    """A square has nine points and a star one; each is drawn as often as the other and as the canvas."""
    scenes = spark.range(6000).select(F.col("id").alias("scene")).withColumn("s", F.explode(F.array(F.lit("square"), F.lit("star"))))
    shapes = scenes.select("scene", F.when(F.col("s") == "square", 0).otherwise(1).alias("z"), F.col("s").alias("shape"), F.lit("red").alias("fill"), *(F.lit(v).alias(n) for n, v in zip("xywh", (10, 20, 30, 40))), F.lit(0).alias("rotation"))
    one = regions.drawn_control_points(shapes, "first")
    n = Counter(r["z"] for r in one.collect())
    assert set(n) == {0, 1, None} and all(1850 < v < 2150 for v in n.values())
    of_square = Counter(r["name"] for r in one.where("z = 0").collect())
    assert len(of_square) == 9 and min(of_square.values()) > 150
    two = regions.drawn_control_points(shapes, "second", exclude=one)
    assert two.count() == 6000 and two.alias("t").join(one.alias("o"), (F.col("t.scene") == F.col("o.scene")) & F.col("t.z").eqNullSafe(F.col("o.z")) & (F.col("t.name") == F.col("o.name"))).count() == 0
    same = regions.drawn_control_points(shapes, "first", exclude=one).where("scene < 300").collect()
    first = {r["scene"]: r for r in one.where("scene < 300").collect()}
    assert all(r["z"] == first[r["scene"]]["z"] for r in same if first[r["scene"]]["z"] != 1), "another point of the same source comes next"
    assert all(r["z"] != 1 for r in same if first[r["scene"]]["z"] == 1), "a source without points left gives way"


def test_parallelograms_fit(spark, sf_dir):
    from pixelloom.plans.q_regions import fitted_parallelograms

    rows = fitted_parallelograms(spark, sf_dir).collect()
    lo, hi = 0.04 * sc.CANVAS - 1e-6, 0.96 * sc.CANVAS + 1e-6
    assert all(lo <= v <= hi for r in rows for v in (r["x"], r["y"], r["clamped_x"], r["clamped_y"])) and any(r["scale"] < 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["scene"], []).append(r)
    for own in by.values():
        tl, tr, br, bl = ((r["x"], r["y"]) for r in sorted(own, key=lambda r: r["k"]))
        assert math.isclose(tr[0] - tl[0], br[0] - bl[0], abs_tol=1e-5) and math.isclose(tr[1] - tl[1], br[1] - bl[1], abs_tol=1e-5)
        if own[0]["scale"] < 1:
            assert min(min(abs(v - lo), abs(v - hi)) for r in own for v in (r["x"], r["y"])) < 1e-4, "the largest scale touches a side"


def test_last_attempt_is_kept_and_plans_stay_in_the_jvm(spark, sf_dir):
    s = derive.shapes(spark, sf_dir)
    never = regions.found_regions(s, regions.around_shape(s), limit=5, least_shape=2.0, name="never").collect()
    assert never and all(r["t"] == 4 and not r["ok"] and len(r["polygon"]) > 2 for r in never)
    plan = regions.drawn_control_points(s, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan
