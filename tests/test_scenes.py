"""Canvases as bits, and layers moved without joins, against cells one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom import catalog
from pixelloom.operators import layers
from pixelloom.operators import scene as sc
from pixelloom.plans import derive


def test_masks_are_the_covered_cells(spark, sf_dir):
    s = derive.shapes(spark, sf_dir)
    own = s.unionByName(s.limit(1).withColumns({"scene": F.lit(7000).cast("long"), "x": F.lit(500)}))
    got = {r["scene"]: r for r in sc.masks(own, low=F.col("z") < 5, high=F.col("z") >= 5).collect()}
    for name, part in (("low", own.where("z < 5")), ("high", own.where("z >= 5"))):
        want = {(r["scene"], r["cx"], r["cy"]) for r in sc.covered_cells(part).collect()}
        assert {(k, cx, cy) for k, r in got.items() for cy, bits in enumerate(r[name]) for cx in range(sc.CELLS) if bits >> cx & 1} == want
    assert got[7000]["low"] == got[7000]["high"] == [0] * sc.CELLS


def test_attempts_are_dealt_by_number_not_by_bytes(spark):
    few = spark.range(50_000).coalesce(1)
    assert sc.dealt(few, 10_000, "id").rdd.getNumPartitions() == 6


#: Queries whose cells aren't joined, or aren't rows at all.
JOINLESS: list[str] = ["flood_fill_region", "nearest_resize", "mask_algebra", "copy_region", "region_coverage", "raster_dilation", ]


def test_cells_are_not_joined(spark, sf_dir):
    for name in JOINLESS:
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan, name


def test_turned_pixels_are_not_joined_with_pixels(spark):
    layer = spark.range(1).selectExpr("0L AS scene", "3 AS cx", "4 AS cy", "'a' AS v")
    turns = spark.range(1).selectExpr("0L AS scene", "30.0D AS degrees", "4.5D AS ox", "4.5D AS oy")
    plan = layers.rotated(layer, turns, 9, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the turns, by scene


def test_shapes_are_dealt_by_scene_before_cells_are_made(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sc, "SHAPES_A_TASK", 50)
    s = derive.shapes(spark, sf_dir)
    assert sc.covered_cells(s).rdd.getNumPartitions() == 1 + s.count() // 50


def test_mirrored_pixels_are_not_joined_with_pixels(spark):
    layer = spark.range(1).selectExpr("0L AS scene", "3 AS cx", "4 AS cy", "1 AS r", "2 AS g", "3 AS b", "255 AS mask")
    line = spark.range(1).selectExpr("0L AS scene", "1.0D AS ax", "0.0D AS ay", "7.0D AS bx", "9.0D AS by")
    plan = layers.reflected(layer, line, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the lines, by scene


def test_outline_of_one_point_and_of_ties(spark, sf_dir, con):
    """Distances that are half the width only when rounded belong to the outline; scenes of one shape have none."""
    edges = spark.createDataFrame([(0, 0.0, 2.0, 40.0, 2.0)], "scene long, ax double, ay double, bx double, by double")
    near = lambda w: {(r["cx"], r["cy"]) for r in layers.stroked(edges, ["scene"], w, step=sc.STEP, cells=sc.CELLS).collect()}
    assert (0, 1) not in near(8 - 4e-7) and (0, 1) in near(8 - 4e-7 + 1e-5)
    one = derive.shapes(spark, sf_dir).where("scene < 3 AND (scene <> 1 OR z = 0)")
    from pixelloom.plans import q_layers

    real, derive.shapes = derive.shapes, lambda *_: one
    try:
        assert {r["scene"] for r in q_layers.polygon_outline(spark, sf_dir).select("scene").distinct().collect()} == {0, 2}
    finally:
        derive.shapes = real


def test_primitives_are_dealt_by_key_before_they_are_made_pixels(spark, monkeypatch):
    monkeypatch.setattr(layers, "PRIMITIVES_A_TASK", 10)
    rows = [(f"k{k}", 0, "rect", 1.0, 1.0, 3.0, 3.0, 0.0, "red") for k in range(40)]
    made = layers.drawn(spark.createDataFrame(rows, "k string, " + layers.PRIMITIVE), "k", 10, 10)
    assert made.rdd.getNumPartitions() == 5 and made.count() == 40 * 9
