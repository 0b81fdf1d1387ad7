"""Queries: scene edits, geometry and raster rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..functions import geometry as geo
from ..operators import scene as sc
from ..registry import query
from . import derive
from .derive import SQL, with_sql

N, S = sc.CELLS, sc.STEP
SQL["cells"] = f"cells AS (SELECT s.*, cx::INT AS cx, cy::INT AS cy FROM shapes s, range(0, {N}) a(cx), range(0, {N}) b(cy) WHERE cx * {S} + {S // 2} BETWEEN x AND x + w AND cy * {S} + {S // 2} BETWEEN y AND y + h)"
SQL["topmost"] = "topmost AS (SELECT scene, cx, cy, arg_max(fill, z) AS fill, max(z) AS z FROM cells GROUP BY ALL)"
SQL["grid_all"] = f"grid_all AS (SELECT scene, cx::INT AS cx, cy::INT AS cy FROM (SELECT DISTINCT scene FROM shapes), range(0, {N}) a(cx), range(0, {N}) b(cy))"


def shapes(spark, sf_dir):
    return derive.shapes(spark, sf_dir)


def cells(spark, sf_dir):
    return sc.all_cells(shapes(spark, sf_dir).select("scene").distinct())


def r6(c):
    return F.round(c, 6)


# -- selection, ranking, counting -----------------------------------------------------------------

@query(with_sql("shapes", query="SELECT * FROM shapes WHERE NOT (shape = 'circle' OR fill = 'red')"))
def removal_attribute(spark, sf_dir):
    return shapes(spark, sf_dir).where(~((F.col("shape") == "circle") | (F.col("fill") == "red")))


@query(with_sql("shapes", query="SELECT * FROM shapes WHERE fill IN ('red', 'blue', 'green')"))
def removal_invert(spark, sf_dir):
    """Everything but the chosen is deleted."""
    return shapes(spark, sf_dir).where(F.col("fill").isin("red", "blue", "green"))


@query(with_sql("shapes", query="SELECT s.* FROM shapes s LEFT JOIN (SELECT scene, max(z) AS top FROM shapes WHERE 50 BETWEEN x AND x + w AND 50 BETWEEN y AND y + h GROUP BY scene) h ON s.scene = h.scene AND s.z = h.top WHERE h.top IS NULL"))
def removal_location(spark, sf_dir):
    """The topmost shape under the pixel (50, 50) goes."""
    s = shapes(spark, sf_dir)
    under = F.lit(50).between(F.col("x"), F.col("x") + F.col("w")) & F.lit(50).between(F.col("y"), F.col("y") + F.col("h"))
    top = F.max(F.when(under, F.col("z"))).over(Window.partitionBy("scene"))
    return s.withColumn("top", top).where(F.col("top").isNull() | (F.col("z") != F.col("top"))).drop("top")


@query(with_sql("shapes", query="SELECT scene, z, shape, CASE WHEN shape IN ('star', 'ring') THEN 'purple' ELSE fill END AS fill FROM shapes"))
def recolor_update(spark, sf_dir):
    return shapes(spark, sf_dir).select("scene", "z", "shape", F.when(F.col("shape").isin("star", "ring"), "purple").otherwise(F.col("fill")).alias("fill"))


@query(with_sql("shapes", query="SELECT scene, z, CASE WHEN z = 0 THEN first_value(fill) OVER (PARTITION BY scene ORDER BY z DESC) ELSE fill END AS fill FROM shapes"))
def recolor_dropper(spark, sf_dir):
    """The bottom shape takes the top shape's colour."""
    top = F.max_by("fill", "z").over(Window.partitionBy("scene"))
    return shapes(spark, sf_dir).select("scene", "z", F.when(F.col("z") == 0, top).otherwise(F.col("fill")).alias("fill"))


@query(with_sql("shapes", query="SELECT scene, z, CASE fill WHEN 'red' THEN 'blue' WHEN 'blue' THEN 'red' WHEN 'white' THEN 'pink' ELSE fill END AS fill FROM shapes WHERE fill NOT IN ('black', 'gray')"))
def legend_mapping(spark, sf_dir):
    """A legend maps colours to colours, or to X: deleted."""
    legend = spark.createDataFrame([("red", "blue"), ("blue", "red"), ("white", "pink"), ("black", "X"), ("gray", "X")], "fill string, to string")
    s = shapes(spark, sf_dir).select("scene", "z", "fill").join(F.broadcast(legend), "fill", "left")
    return s.where("to IS NULL OR to <> 'X'").select("scene", "z", F.coalesce("to", "fill").alias("fill"))


@query(with_sql("shapes", query="SELECT scene, z, shape, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY w * h DESC, z) AS p FROM shapes) WHERE p = 3"))
def nth_rank(spark, sf_dir):
    """The third largest shape of each scene."""
    area = F.col("w") * F.col("h")
    s = shapes(spark, sf_dir)
    return s.withColumn("p", sc.ranked(s, area, True)).where("p = 3").select("scene", "z", "shape", area.alias("area"))


@query(with_sql("shapes", query="SELECT a.scene, a.z, b.w, b.h FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY x, z) AS p FROM shapes) a JOIN (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY w * h, z) AS p FROM shapes) b ON a.scene = b.scene AND a.p = b.p"))
def ordering_reassign(spark, sf_dir):
    """Shapes from left to right get the sizes in ascending order."""
    s = shapes(spark, sf_dir)
    places = s.select("scene", "z", F.row_number().over(Window.partitionBy("scene").orderBy("x", "z")).alias("p"))
    sizes = s.select("scene", "w", "h", F.row_number().over(Window.partitionBy("scene").orderBy(F.col("w") * F.col("h"), "z")).alias("p"))
    return places.join(sizes, ["scene", "p"]).select("scene", "z", "w", "h")


@query(with_sql("shapes", query="SELECT scene, count_if(shape = 'star') AS n_shape, count_if(fill = 'red') AS n_color, count_if(shape = 'star' AND fill = 'red') AS n_both, count_if(shape <> 'star' AND fill <> 'red') AS n_none FROM shapes GROUP BY scene"))
def count_contingency(spark, sf_dir):
    a, b = F.col("shape") == "star", F.col("fill") == "red"
    return shapes(spark, sf_dir).groupBy("scene").agg(F.count_if(a).alias("n_shape"), F.count_if(b).alias("n_color"), F.count_if(a & b).alias("n_both"), F.count_if(~a & ~b).alias("n_none"))


@query(with_sql("shapes", query="SELECT scene, z FROM (SELECT scene, z, row_number() OVER (PARTITION BY scene ORDER BY z) AS p, count(*) OVER (PARTITION BY scene) AS n, scene % 2 AS tail FROM shapes) WHERE CASE WHEN tail = 0 THEN p <= 4 ELSE p > n - 4 END"))
def tally_keep(spark, sf_dir):
    """Of ten tally marks the first four stay, or the last four."""
    w = Window.partitionBy("scene")
    s = shapes(spark, sf_dir).select("scene", "z", F.row_number().over(w.orderBy("z")).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    return s.where(F.when(F.col("scene") % 2 == 0, F.col("p") <= 4).otherwise(F.col("p") > F.col("n") - 4)).select("scene", "z")


@query(with_sql("shapes", query="SELECT scene, fill, count(*) AS n, greatest(2, ceil(max(t) / 3.0e0))::BIGINT AS cap, count(*) > greatest(2, ceil(max(t) / 3.0e0)) AS over_cap FROM (SELECT *, count(*) OVER (PARTITION BY scene) AS t FROM shapes) GROUP BY scene, fill"))
def cap_counts(spark, sf_dir):
    """Shapes per colour against the cap max(2, ceil(n / 3))."""
    s = shapes(spark, sf_dir).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("scene")))
    g = s.groupBy("scene", "fill").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(2), F.ceil(F.max("t") / 3)).cast("long").alias("cap"))
    return g.withColumn("over_cap", F.col("n") > F.col("cap"))


@query(with_sql("shapes", query="SELECT scene, z, CASE WHEN cf = 1 THEN 'the ' || fill || ' shape' WHEN cs = 1 THEN 'the ' || shape ELSE 'the ' || fill || ' ' || shape END AS description FROM (SELECT *, count(*) OVER (PARTITION BY scene, fill) AS cf, count(*) OVER (PARTITION BY scene, shape) AS cs FROM shapes)"))
def unique_descriptor(spark, sf_dir):
    d = F.when(sc.unique_in_scene("fill"), F.concat(F.lit("the "), "fill", F.lit(" shape"))).when(sc.unique_in_scene("shape"), F.concat(F.lit("the "), "shape")).otherwise(F.concat(F.lit("the "), "fill", F.lit(" "), "shape"))
    return shapes(spark, sf_dir).select("scene", "z", d.alias("description"))


# -- overlap and containment ------------------------------------------------------------------------

@query(with_sql("shapes", query="SELECT a.scene, a.z AS za, b.z AS zb, NOT (a.x + a.w + 4 <= b.x OR b.x + b.w + 4 <= a.x OR a.y + a.h + 4 <= b.y OR b.y + b.h + 4 <= a.y) AS strict FROM shapes a JOIN shapes b ON a.scene = b.scene AND a.z < b.z WHERE NOT (a.x + a.w + 4 < b.x OR b.x + b.w + 4 < a.x OR a.y + a.h + 4 < b.y OR b.y + b.h + 4 < a.y)"))
def spatial_overlap_join(spark, sf_dir):
    """Pairs of a scene's ten shapes whose boxes come within four pixels."""
    s = shapes(spark, sf_dir)
    a, b = s.alias("a"), s.alias("b")
    ends = lambda t: [F.col(f"{t}.x"), F.col(f"{t}.y"), F.col(f"{t}.x") + F.col(f"{t}.w"), F.col(f"{t}.y") + F.col(f"{t}.h")]
    j = a.join(b, (F.col("a.scene") == F.col("b.scene")) & (F.col("a.z") < F.col("b.z"))).where(geo.overlaps(ends("a"), ends("b"), 4, True))
    return j.select(F.col("a.scene").alias("scene"), F.col("a.z").alias("za"), F.col("b.z").alias("zb"), geo.overlaps(ends("a"), ends("b"), 4, False).alias("strict"))


@query(with_sql("shapes", query="SELECT scene, z, cx BETWEEN 20 AND 70 AND cy BETWEEN 20 AND 70 AS straight, round(u, 6) BETWEEN -25 AND 25 AND round(v, 6) BETWEEN -25 AND 25 AS tilted FROM (SELECT *, (cx - 45) * cos(radians(30e0)) + (cy - 45) * sin(radians(30e0)) AS u, -(cx - 45) * sin(radians(30e0)) + (cy - 45) * cos(radians(30e0)) AS v FROM (SELECT *, x + w / 2.0e0 AS cx, y + h / 2.0e0 AS cy FROM shapes))"))
def range_box_contains(spark, sf_dir):
    """Is a shape's centre in a crop box, straight and tilted by 30 degrees?"""
    cx, cy = sc.centre()
    u, v = geo.rotate((cx, cy), (F.lit(45.0), F.lit(45.0)), F.lit(-30.0))
    return shapes(spark, sf_dir).select("scene", "z", (cx.between(20, 70) & cy.between(20, 70)).alias("straight"), (r6(u - 45).between(-25, 25) & r6(v - 45).between(-25, 25)).alias("tilted"))


POLY = ((10.0, 15.0), (80.0, 5.0), (100.0, 60.0), (55.0, 95.0), (20.0, 70.0))


def _poly_sql(px: str, py: str) -> str:
    terms = []
    for (ax, ay), (bx, by) in zip(POLY, POLY[1:] + POLY[:1]):
        terms.append(f"CASE WHEN ({ay}e0 > {py}) <> ({by}e0 > {py}) AND {px} < {ax}e0 + ({py} - {ay}e0) / {by - ay}e0 * {bx - ax}e0 THEN 1 ELSE 0 END")
    return "((" + " + ".join(terms) + ") % 2 = 1)"


def _poly():
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POLY))


@query(with_sql("shapes", query=f"SELECT scene, z, {_poly_sql('(x + w / 2.0e0)', '(y + h / 2.0e0)')} AS inside FROM shapes"))
def point_in_polygon(spark, sf_dir):
    return shapes(spark, sf_dir).select("scene", "z", geo.inside(*sc.centre(), _poly()).alias("inside"))


_C = f"(cx * {S} + {S // 2})::DOUBLE"
_D = f"(cy * {S} + {S // 2})::DOUBLE"


def _px():
    return (F.col("cx") * S + S // 2).cast("double"), (F.col("cy") * S + S // 2).cast("double")


def _poly_rows() -> list[int]:
    """``POLY`` on every canvas: for each row of cells a number whose bit cx is set if the cell's centre is inside, by the even-odd rule."""
    def inside(px: float, py: float) -> bool:
        ends = zip(POLY, POLY[1:] + POLY[:1])
        return sum((ay > py) != (by > py) and px < ax + (py - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in ends) % 2 == 1

    return [sum(inside(float(cx * S + S // 2), float(cy * S + S // 2)) << cx for cx in range(N)) for cy in range(N)]


@query(with_sql("shapes", "cells", "grid_all", query=f"SELECT g.scene, round(avg((c.scene IS NOT NULL)::INT), 9) AS foreground, round(1 - avg((c.scene IS NOT NULL)::INT), 9) AS background FROM grid_all g LEFT JOIN (SELECT DISTINCT scene, cx, cy FROM cells) c ON g.scene = c.scene AND g.cx = c.cx AND g.cy = c.cy WHERE {_poly_sql(_C.replace('cx', 'g.cx'), _D.replace('cy', 'g.cy'))} GROUP BY ALL"))
def region_coverage(spark, sf_dir):
    # The polygon covers the same cells of every canvas.
    region = _poly_rows()
    share = sc.n_set(lambda cy: F.col("own")[cy].bitwiseAND(F.lit(region[cy]).cast("long"))) / F.lit(sum(b.bit_count() for b in region))
    return sc.masks(shapes(spark, sf_dir), own=F.lit(True)).select("scene", F.round(share, 9).alias("foreground"), F.round(1 - share, 9).alias("background"))


@query(with_sql("shapes", query="SELECT scene, z, round(greatest(0, least(x + w, 96) - greatest(x, 12)) * greatest(0, least(y + h, 96) - greatest(y, 12)) / (w * h), 9) AS visible, 4 * greatest(0, least(x + w, 96) - greatest(x, 12)) * greatest(0, least(y + h, 96) - greatest(y, 12)) >= w * h AS enough FROM shapes"))
def clip_overlap(spark, sf_dir):
    side = lambda a, s: F.greatest(F.lit(0), F.least(F.col(a) + F.col(s), F.lit(96)) - F.greatest(F.col(a), F.lit(12)))
    seen, area = side("x", "w") * side("y", "h"), F.col("w") * F.col("h")
    return shapes(spark, sf_dir).select("scene", "z", F.round(seen / area, 9).alias("visible"), (seen * 4 >= area).alias("enough"))


# -- geometry ----------------------------------------------------------------------------------------

@query(with_sql("shapes", query="SELECT scene, z, round(x + 105 * (scene % 7 - 3) / 20.0e0, 6) AS x, round(y + CASE WHEN scene % 3 = 0 THEN 0 ELSE 105 * (scene % 5 - 2) / 20.0e0 END, 6) AS y FROM shapes"))
def geom_translate(spark, sf_dir):
    """Moves by percents of the canvas, on one axis or both."""
    k = F.col("scene")
    return shapes(spark, sf_dir).select("scene", "z", r6(F.col("x") + (k % 7 - 3) * 105 / 20.0).alias("x"), r6(F.col("y") + F.when(k % 3 == 0, F.lit(0.0)).otherwise((k % 5 - 2) * 105 / 20.0)).alias("y"))


@query(with_sql("shapes", query="SELECT scene, z, round(50 + (x - 50) * cos(a) - (y - 50) * sin(a), 6) AS x, round(50 + (x - 50) * sin(a) + (y - 50) * cos(a), 6) AS y FROM (SELECT *, radians(rotation::DOUBLE) AS a FROM shapes)"))
def geom_rotate(spark, sf_dir):
    x, y = geo.rotate((F.col("x"), F.col("y")), (F.lit(50.0), F.lit(50.0)), F.col("rotation"))
    return shapes(spark, sf_dir).select("scene", "z", r6(x).alias("x"), r6(y).alias("y"))


@query(with_sql("shapes", query="SELECT scene, z, k::INT AS k, round(x + [0, 0.5e0, 1][k % 3 + 1] * w, 6) AS px, round(y + [0, 0.5e0, 1][k // 3 + 1] * h, 6) AS py FROM shapes, range(0, 9) AS r(k)"))
def geom_scale(spark, sf_dir):
    """Nine points of the unit square in every shape's box."""
    s = shapes(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x, y = geo.scale_into((F.col("k") % 3 / 2, F.floor(F.col("k") / 3) / 2), sc.box())
    return s.select("scene", "z", "k", r6(x).alias("px"), r6(y).alias("py"))


@query(with_sql("shapes", query="SELECT scene, z, round(CASE WHEN a IN ('left', 'nw') THEN x WHEN a = 'right' THEN x + w - w * f ELSE x + (w - w * f) / 2 END, 6) AS x, round(CASE WHEN a = 'nw' THEN y WHEN a IN ('left', 'right') THEN y ELSE y + (h - h * f) / 2 END, 6) AS y, round(w * f, 6) AS w, round(CASE WHEN a IN ('left', 'right') THEN h ELSE h * f END, 6) AS h FROM (SELECT *, ['left', 'right', 'center', 'nw'][scene % 4 + 1] AS a, 0.4e0 + z * 0.2e0 AS f FROM shapes)"))
def geom_scale_anchor(spark, sf_dir):
    """One- and two-sided scaling about an anchor that stays."""
    a, f = dims.pick(("left", "right", "center", "nw"), F.col("scene") % 4), F.lit(0.4) + F.col("z") * 0.2
    x, y, w, h = sc.box()
    one = a.isin("left", "right")
    nx = F.when(a.isin("left", "nw"), x).when(a == "right", x + w - w * f).otherwise(x + (w - w * f) / 2)
    ny = F.when((a == "nw") | one, y).otherwise(y + (h - h * f) / 2)
    return shapes(spark, sf_dir).select("scene", "z", r6(nx).alias("x"), r6(ny).alias("y"), r6(w * f).alias("w"), r6(F.when(one, h).otherwise(h * f)).alias("h"))


@query(with_sql("shapes", query="SELECT scene, z, side, round(x + CASE side WHEN 'bottom' THEN k * w WHEN 'top' THEN 0 WHEN 'center_h' THEN k * w * -0.5e0 ELSE 0 END, 6) AS x, round(y + CASE side WHEN 'right' THEN k * h WHEN 'left' THEN 0 WHEN 'center_v' THEN k * h * -0.5e0 ELSE 0 END, 6) AS y FROM (SELECT *, ['bottom', 'top', 'center_h', 'right', 'left', 'center_v'][scene % 6 + 1] AS side, 0.2e0 + z * 0.06e0 AS k FROM shapes)"))
def geom_shear(spark, sf_dir):
    """Where shearing takes the upper left corner."""
    side, k = dims.pick(("bottom", "top", "center_h", "right", "left", "center_v"), F.col("scene") % 6), F.lit(0.2) + F.col("z") * 0.06
    x, y = geo.shear((F.col("x").cast("double"), F.col("y").cast("double")), sc.box(), k, side)
    return shapes(spark, sf_dir).select("scene", "z", side.alias("side"), r6(x).alias("x"), r6(y).alias("y"))


@query(with_sql("shapes", query="SELECT scene, z, round(2 * (10 + t * 60) - x, 6) AS x, round(2 * (20 + t * 40) - y, 6) AS y FROM (SELECT *, ((x - 10) * 60.0e0 + (y - 20) * 40.0e0) / 5200.0e0 AS t FROM shapes)"))
def geom_reflect(spark, sf_dir):
    x, y = geo.reflect((F.col("x"), F.col("y")), (F.lit(10.0), F.lit(20.0)), (F.lit(70.0), F.lit(60.0)))
    return shapes(spark, sf_dir).select("scene", "z", r6(x).alias("x"), r6(y).alias("y"))


@query(with_sql("shapes", query="SELECT scene, z, round((x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, 1e-9), 9) AS u, round((y - min(y) OVER w) / greatest(max(y) OVER w - min(y) OVER w, 1e-9), 9) AS v, round((max(x) OVER w - min(x) OVER w) / greatest(max(y) OVER w - min(y) OVER w, 1e-9), 9) AS aspect FROM shapes WINDOW w AS (PARTITION BY scene)"))
def geom_normalize(spark, sf_dir):
    w = Window.partitionBy("scene")
    lo = {c: F.min(c).over(w) for c in "xy"}
    spread = {c: F.greatest((F.max(c).over(w) - lo[c]).cast("double"), F.lit(1e-9)) for c in "xy"}
    return shapes(spark, sf_dir).select("scene", "z", F.round((F.col("x") - lo["x"]) / spread["x"], 9).alias("u"), F.round((F.col("y") - lo["y"]) / spread["y"], 9).alias("v"), F.round((F.max("x").over(w) - lo["x"]) / spread["y"], 9).alias("aspect"))


_CORNERS = """SELECT scene, z, k::INT AS k, mx + (px - mx) * cos(a) - (py - my) * sin(a) AS px, my + (px - mx) * sin(a) + (py - my) * cos(a) AS py FROM (SELECT *, x + w / 2.0e0 AS mx, y + h / 2.0e0 AS my, radians(rotation::DOUBLE) AS a, x + [0, 1, 1, 0][k + 1] * w AS px, y + [0, 0, 1, 1][k + 1] * h AS py FROM shapes, range(0, 4) AS r(k))"""


def _corner_rows(spark, sf_dir):
    pts = geo.corners(sc.box(), F.col("rotation"))
    arr = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("px"), y.alias("py")) for k, (x, y) in enumerate(pts)))
    return shapes(spark, sf_dir).select("scene", "z", F.explode(arr).alias("p")).select("scene", "z", "p.*")


@query(with_sql("shapes", query=f"SELECT scene, z, k, round(px, 6) AS px, round(py, 6) AS py FROM ({_CORNERS})"))
def crop_corners(spark, sf_dir):
    return _corner_rows(spark, sf_dir).select("scene", "z", "k", r6("px").alias("px"), r6("py").alias("py"))


@query(with_sql("shapes", query=f"SELECT scene, z, round(min(px), 6) AS x1, round(min(py), 6) AS y1, round(max(px), 6) AS x2, round(max(py), 6) AS y2 FROM ({_CORNERS}) GROUP BY ALL"))
def bbox_aggregate(spark, sf_dir):
    return _corner_rows(spark, sf_dir).groupBy("scene", "z").agg(r6(F.min("px")).alias("x1"), r6(F.min("py")).alias("y1"), r6(F.max("px")).alias("x2"), r6(F.max("py")).alias("y2"))


_NINE = ("top_left", "top", "top_right", "left", "center", "right", "bottom_left", "bottom", "bottom_right")


@query(with_sql("shapes", query=f"SELECT scene, z, {dims.sql_list(_NINE)}[k + 1] AS name, round(x1 + [0, 0.5e0, 1][k % 3 + 1] * (x2 - x1), 5) AS px, round(y1 + [0, 0.5e0, 1][k // 3 + 1] * (y2 - y1), 5) AS py FROM (SELECT scene, z, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM ({_CORNERS}) GROUP BY ALL), range(0, 9) AS r(k)"))
def control_points(spark, sf_dir):
    """Nine named points of the turned shape's bounding box."""
    b = _corner_rows(spark, sf_dir).groupBy("scene", "z").agg(*(f(c).alias(n) for f, c, n in ((F.min, "px", "x1"), (F.min, "py", "y1"), (F.max, "px", "x2"), (F.max, "py", "y2"))))
    arr = F.array(*(F.struct(F.lit(n).alias("name"), F.round(F.col("x1") + k % 3 / 2 * (F.col("x2") - F.col("x1")), 5).alias("px"), F.round(F.col("y1") + k // 3 / 2 * (F.col("y2") - F.col("y1")), 5).alias("py")) for k, n in enumerate(_NINE)))
    return b.select("scene", "z", F.explode(arr).alias("p")).select("scene", "z", "p.*")


def _unit_sql(n: int) -> str:
    return "(VALUES " + ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, (x, y) in enumerate(geo.unit(geo.ngon(n)))) + ")"


@query(with_sql("shapes", query=" UNION ALL ".join(f"SELECT scene, z, k::INT AS k, round(x + u * w, 6) AS px, round(y + v * h, 6) AS py FROM shapes, {_unit_sql(n)} AS t{n}(k, u, v) WHERE shape = '{name}'" for name, n in (("triangle", 3), ("pentagon", 5), ("hexagon", 6)))))
def shape_polygons(spark, sf_dir):
    """Vertices of the regular polygons in their boxes."""
    poly = lambda n: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("u"), F.lit(y).alias("v")) for k, (x, y) in enumerate(geo.unit(geo.ngon(n)))))
    s = shapes(spark, sf_dir).withColumn("poly", F.when(F.col("shape") == "triangle", poly(3)).when(F.col("shape") == "pentagon", poly(5)).when(F.col("shape") == "hexagon", poly(6)))
    x, y = geo.scale_into((F.col("p.u"), F.col("p.v")), sc.box())
    return s.where("poly IS NOT NULL").select("scene", "z", "x", "y", "w", "h", F.explode("poly").alias("p")).select("scene", "z", "p.k", r6(x).alias("px"), r6(y).alias("py"))


@query(with_sql("shapes", query="SELECT scene, string_agg(lpad(z::VARCHAR, 2, '0'), ',' ORDER BY round(atan2(cy - my, cx - mx), 9), z) AS ring FROM (SELECT *, avg(cx) OVER w AS mx, avg(cy) OVER w AS my FROM (SELECT scene, z, x + w / 2.0e0 AS cx, y + h / 2.0e0 AS cy FROM shapes) WINDOW w AS (PARTITION BY scene)) GROUP BY scene"))
def polygon_angular_order(spark, sf_dir):
    """Centres around their mean, by angle."""
    cx, cy = sc.centre()
    w = Window.partitionBy("scene")
    s = shapes(spark, sf_dir).select("scene", "z", cx.alias("cx"), cy.alias("cy")).withColumn("mx", F.avg("cx").over(w)).withColumn("my", F.avg("cy").over(w))
    s = s.withColumn("a", F.round(F.atan2(F.col("cy") - F.col("my"), F.col("cx") - F.col("mx")), 9))
    ring = F.transform(F.sort_array(F.collect_list(F.struct("a", "z"))), lambda p: F.lpad(p["z"].cast("string"), 2, "0"))
    return s.groupBy("scene").agg(F.array_join(ring, ",").alias("ring"))


@query(with_sql("shapes", query="SELECT a.scene, a.z AS za, b.z AS zb, c.z AS zc FROM shapes a JOIN shapes b ON a.scene = b.scene AND a.z < b.z JOIN shapes c ON b.scene = c.scene AND b.z < c.z WHERE abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) <= 40"))
def collinear_triples(spark, sf_dir):
    """Triples of a scene's ten shapes whose triangle is nearly flat."""
    s = shapes(spark, sf_dir).select("scene", "z", "x", "y")
    a, b, c = (s.select("scene", *(F.col(k).alias(f"{k}{t}") for k in ("z", "x", "y"))) for t in "abc")
    j = a.join(b, "scene").where("za < zb").join(c, "scene").where("zb < zc")
    flat = F.abs((F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("xc") - F.col("xa")) * (F.col("yb") - F.col("ya")))
    return j.where(flat <= 40).select("scene", "za", "zb", "zc")


# -- raster ------------------------------------------------------------------------------------------

@query(with_sql("shapes", "cells", "topmost", query="SELECT * FROM topmost"))
def zorder_topmost(spark, sf_dir):
    return sc.topmost(shapes(spark, sf_dir))


@query(with_sql("shapes", "cells", query="SELECT scene, cx, cy, count(*) AS n FROM cells GROUP BY ALL"))
def occupancy(spark, sf_dir):
    return sc.covered_cells(shapes(spark, sf_dir)).groupBy("scene", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("shapes", "cells", query="SELECT scene, count(*) FILTER (WHERE a AND b) AS n_and, count(*) FILTER (WHERE a AND NOT b) AS n_and_not, count(*) FILTER (WHERE a OR b) AS n_or, count(*) FILTER (WHERE a <> b) AS n_xor FROM (SELECT scene, cx, cy, bool_or(z < 5) AS a, bool_or(z >= 5) AS b FROM cells GROUP BY ALL) GROUP BY scene"))
def mask_algebra(spark, sf_dir):
    m = sc.masks(shapes(spark, sf_dir), a=F.col("z") < 5, b=F.col("z") >= 5)
    a, b = (lambda cy: F.col("a")[cy]), (lambda cy: F.col("b")[cy])
    n = {
        "n_and": lambda cy: a(cy).bitwiseAND(b(cy)), "n_and_not": lambda cy: a(cy).bitwiseAND(F.bitwise_not(b(cy))),
        "n_or": lambda cy: a(cy).bitwiseOR(b(cy)), "n_xor": lambda cy: a(cy).bitwiseXOR(b(cy)),
    }
    return m.select("scene", *(sc.n_set(f).alias(k) for k, f in n.items())).where("n_or > 0")


@query(with_sql("shapes", "grid_all", query=f"SELECT scene, cx, cy, {_poly_sql(_C, _D)} AS inside FROM grid_all"))
def raster_polygon(spark, sf_dir):
    return cells(spark, sf_dir).select("scene", "cx", "cy", geo.inside_fixed(*_px(), POLY).alias("inside"))


@query(with_sql("shapes", "cells", query=f"SELECT scene, z, count(*) AS n_outer, count_if(NOT (4 * pow({_C} - x - w / 2.0e0, 2) / (w * w) + 4 * pow({_D} - y - h / 2.0e0, 2) / (h * h) <= 0.36e0)) AS n_ring FROM cells WHERE 4 * pow({_C} - x - w / 2.0e0, 2) / (w * w) + 4 * pow({_D} - y - h / 2.0e0, 2) / (h * h) <= 1 GROUP BY ALL"))
def raster_ring(spark, sf_dir):
    """Ellipse less the ellipse of 0.6 times its axes."""
    px, py = _px()
    x, y, w, h = sc.box()
    d = 4 * F.pow(px - x - w / 2, F.lit(2)) / (w * w) + 4 * F.pow(py - y - h / 2, F.lit(2)) / (h * h)
    return sc.covered_cells(shapes(spark, sf_dir)).where(d <= 1).groupBy("scene", "z").agg(F.count(F.lit(1)).alias("n_outer"), F.count_if(~(d <= 0.36)).alias("n_ring"))


@query(with_sql("shapes", "grid_all", query=f"SELECT scene, cx, cy, (((floor(round((d - CASE scene % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 * sin(2 * {math.pi!r} * t) ELSE 5 * (2 * t - 1) END) / 12, 9))::INT % 3) + 3) % 3)::INT AS band FROM (SELECT *, s / 40 - floor(s / 40) AS t FROM (SELECT *, ({_C} - 54) * cos(a) + ({_D} - 54) * sin(a) AS d, -({_C} - 54) * sin(a) + ({_D} - 54) * cos(a) AS s FROM (SELECT *, radians(scene % 12 * 15.0e0) AS a FROM grid_all)))"))
def raster_background(spark, sf_dir):
    """Bands with straight, sine or sawtooth edges at an angle."""
    a = F.radians(F.col("scene") % 12 * 15.0)
    px, py = _px()
    g = cells(spark, sf_dir).withColumn("d", (px - 54) * F.cos(a) + (py - 54) * F.sin(a)).withColumn("s", -(px - 54) * F.sin(a) + (py - 54) * F.cos(a))
    g = g.withColumn("t", F.col("s") / 40 - F.floor(F.col("s") / 40))
    shift = F.when(F.col("scene") % 3 == 0, F.lit(0.0)).when(F.col("scene") % 3 == 1, F.sin(F.col("t") * 2 * math.pi) * 5).otherwise((F.col("t") * 2 - 1) * 5)
    return g.select("scene", "cx", "cy", F.pmod(F.floor(F.round((F.col("d") - shift) / 12, 9)), F.lit(3)).cast("int").alias("band"))


@query(with_sql("shapes", "cells", query=f"SELECT scene, count(*) AS n_ring FROM (SELECT DISTINCT scene, cx + dx AS cx, cy + dy AS cy FROM cells, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4 EXCEPT SELECT scene, cx, cy FROM cells) WHERE cx BETWEEN 0 AND {N - 1} AND cy BETWEEN 0 AND {N - 1} GROUP BY scene"))
def raster_dilation(spark, sf_dir):
    """Cells within two steps (Euclidean) of a shape but not in one."""
    own = lambda cy: F.col("own")[cy]

    def moved(cy: int, dx: int, dy: int):
        if not 0 <= cy - dy < N:
            return F.lit(0).cast("long")
        return F.shiftleft(own(cy - dy), dx) if dx >= 0 else F.shiftright(own(cy - dy), -dx)

    disc = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 4]
    wide = lambda cy: reduce(lambda a, b: a.bitwiseOR(b), (moved(cy, *d) for d in disc)).bitwiseAND(F.lit((1 << N) - 1).cast("long"))
    n = sc.n_set(lambda cy: wide(cy).bitwiseAND(F.bitwise_not(own(cy))))
    return sc.masks(shapes(spark, sf_dir), own=F.lit(True)).select("scene", n.alias("n_ring")).where("n_ring > 0")


@query(with_sql("shapes", "grid_all", "cells", query=f"SELECT g.scene, count(*) FILTER (WHERE {_poly_sql(_C.replace('cx', 'g.cx'), _D.replace('cy', 'g.cy'))} AND c.scene IS NULL) AS n_background, count(*) FILTER (WHERE {_poly_sql(_C.replace('cx', 'g.cx'), _D.replace('cy', 'g.cy'))} AND c.scene IS NOT NULL) AS n_foreground FROM grid_all g LEFT JOIN (SELECT DISTINCT scene, cx, cy FROM cells) c ON g.scene = c.scene AND g.cx = c.cx AND g.cy = c.cy GROUP BY g.scene"))
def flood_fill_region(spark, sf_dir):
    """Cells of the region that background and foreground filling would change."""
    region = [F.lit(b).cast("long") for b in _poly_rows()]
    own = lambda cy: F.col("own")[cy]
    on, off = sc.n_set(lambda cy: region[cy].bitwiseAND(own(cy))), sc.n_set(lambda cy: region[cy].bitwiseAND(F.bitwise_not(own(cy))))
    return sc.masks(shapes(spark, sf_dir), own=F.lit(True)).select("scene", off.alias("n_background"), on.alias("n_foreground"))


@query("SELECT p_partkey, al AS alpha, ((a * (255 - al) + b * al + 127) // 255)::INT AS blended FROM (SELECT p_partkey, round_even((10 + p_partkey % 81) * 2.55e0, 0)::INT AS al, (p_partkey % 256)::INT AS a, (p_partkey * 7 % 256)::INT AS b FROM part)")
def alpha_blend(spark, sf_dir):
    """Integer blend at 10 to 90 percent, rounded to nearest."""
    k = F.col("p_partkey")
    p = derive.read(spark, sf_dir, "part").select("p_partkey", F.bround((k % 81 + 10) * 2.55).cast("int").alias("alpha"), (k % 256).alias("a"), (k * 7 % 256).alias("b"))
    return p.select("p_partkey", "alpha", F.floor((F.col("a") * (255 - F.col("alpha")) + F.col("b") * F.col("alpha") + 127) / 255).cast("int").alias("blended"))


@query(with_sql("shapes", "grid_all", query=f"SELECT scene, cx, cy, floor(20 + (220 - 20) * greatest(0, least(1, CASE scene % 3 WHEN 0 THEN ({_C} - 10) / 80 WHEN 1 THEN ({_D} - 10) / 80 ELSE (({_C} - 10) + ({_D} - 10)) / 160 END)) + 0.5e0)::INT AS v FROM grid_all"))
def linear_gradient(spark, sf_dir):
    """Side to side, top to bottom, or corner to corner."""
    px, py = _px()
    t = F.when(F.col("scene") % 3 == 0, (px - 10) / 80).when(F.col("scene") % 3 == 1, (py - 10) / 80).otherwise((px - 10 + py - 10) / 160)
    return cells(spark, sf_dir).select("scene", "cx", "cy", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 200 + 20 + 0.5).cast("int").alias("v"))


@query("SELECT p_partkey, 255 - r AS inv_r, 255 - g AS inv_g, ((r * 299 + g * 587 + b * 114 + 500) // 1000)::INT AS gray, greatest(0, least(255, r + p_size - 25)) AS bright FROM (SELECT *, (p_partkey % 256)::INT AS r, (p_partkey * 3 % 256)::INT AS g, (p_partkey * 7 % 256)::INT AS b FROM part)")
def point_ops(spark, sf_dir):
    """Inversion, integer grey, brightness with clamping."""
    k = F.col("p_partkey")
    r, g, b = (k % 256).cast("int"), (k * 3 % 256).cast("int"), (k * 7 % 256).cast("int")
    gray = F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")
    return derive.read(spark, sf_dir, "part").select("p_partkey", (255 - r).alias("inv_r"), (255 - g).alias("inv_g"), gray.alias("gray"), F.greatest(F.lit(0), F.least(F.lit(255), r + F.col("p_size") - 25)).alias("bright"))


@query(with_sql("shapes", "cells", "topmost", "grid_all", query=f"SELECT g.scene, g.cx, g.cy, coalesce(t.fill, 'none') AS fill FROM grid_all g LEFT JOIN topmost t ON g.scene = t.scene AND t.cx = least({N - 1}, floor((g.cx + 0.5e0) * 15 / {N})::INT + 6) AND t.cy = least({N - 1}, floor((g.cy + 0.5e0) * 15 / {N})::INT + 6)"))
def nearest_resize(spark, sf_dir):
    """A crop of 15 x 15 cells from (6, 6) blown up to the whole canvas."""
    # Every source cell is handed to the cells that show it, and what is under all shapes is one more shape: nothing is joined.
    shown: list[list[int]] = [[] for _ in range(N)]
    for c in range(N):
        shown[min(N - 1, math.floor((c + 0.5) * 15 / N) + 6)].append(c)
    to = lambda c: F.element_at(F.array(*(F.array(*map(F.lit, own)).cast("array<int>") for own in shown)), F.col(c) + 1)
    s = shapes(spark, sf_dir).select("scene", "z", "fill", "x", "y", "w", "h")
    ground = s.select("scene").distinct().select("scene", F.lit(-1).alias("z"), F.lit("none").alias("fill"), *(F.lit(v).alias(c) for c, v in zip("xywh", (0, 0, sc.CANVAS, sc.CANVAS))))
    used = [c for c in range(N) if shown[c]]
    t = sc.topmost(s.unionByName(ground)).where(F.col("cx").between(used[0], used[-1]) & F.col("cy").between(used[0], used[-1]))
    return t.select("scene", "fill", to("cy").alias("_ys"), F.explode(to("cx")).alias("cx")).select("scene", "cx", F.explode("_ys").alias("cy"), "fill")


@query(with_sql("shapes", "cells", "topmost", query=f"SELECT scene, cx, cy, arg_max(fill, pri) AS fill FROM (SELECT scene, cx, cy, fill, 0 AS pri FROM topmost UNION ALL SELECT scene, cx + 5, cy + 7, fill, 1 FROM topmost WHERE {_poly_sql(_C, _D)}) WHERE cx < {N} AND cy < {N} GROUP BY ALL"))
def copy_region(spark, sf_dir):
    """Painted cells of the region copied five right, seven down, over what is there."""
    # A copied cell beats what is there, and among either the topmost shape wins: one grouping, no cell is made twice.
    own = sc.covered_cells(shapes(spark, sf_dir))
    copy = F.when(geo.inside_fixed(*_px(), POLY), F.struct((F.col("cx") + 5).alias("cx"), (F.col("cy") + 7).alias("cy"), F.lit(1).alias("pri")))
    both = own.select("scene", "fill", "z", F.explode(F.array_compact(F.array(F.struct("cx", "cy", F.lit(0).alias("pri")), copy))).alias("c")).select("scene", "fill", "z", "c.*")
    return both.where((F.col("cx") < N) & (F.col("cy") < N)).groupBy("scene", "cx", "cy").agg(F.max_by("fill", F.struct("pri", "z")).alias("fill"))


@query(with_sql("shapes", "grid_all", query=f"SELECT scene, count_if(pow({_C} - 54, 2) + pow({_D} - 54, 2) <= r * r) AS n_circle, count_if(pow({_C} - px, 2) + pow({_D} - py, 2) <= 9) AS n_line FROM (SELECT *, 20 + scene % 30 AS r, 10 + greatest(0, least(1, (({_C} - 10) * 80 + ({_D} - 20) * 50) / 8900.0e0)) * 80 AS px, 20 + greatest(0, least(1, (({_C} - 10) * 80 + ({_D} - 20) * 50) / 8900.0e0)) * 50 AS py FROM grid_all) GROUP BY scene"))
def raster_circle_line(spark, sf_dir):
    """Cells of a filled circle, and of a line three wide with round caps."""
    cx, cy = _px()
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - 10) * 80 + (cy - 20) * 50) / 8900.0))
    r = F.col("scene") % 30 + 20
    d = lambda x, y: F.pow(cx - x, F.lit(2)) + F.pow(cy - y, F.lit(2))
    return cells(spark, sf_dir).groupBy("scene").agg(F.count_if(d(54, 54) <= r * r).alias("n_circle"), F.count_if(d(t * 80 + 10, t * 50 + 20) <= 9).alias("n_line"))


@query(with_sql("shapes", query="SELECT DISTINCT scene, r::INT AS r, c::INT AS c FROM (SELECT scene, a.r, b.c FROM (SELECT DISTINCT scene FROM shapes), range(0, 6) a(r), range(0, 6) b(c) WHERE a.r >= scene % 3 AND a.r < scene % 3 + 3 AND b.c < 3 UNION ALL SELECT DISTINCT scene, 5, 5 FROM shapes)"))
def pattern_must_keep(spark, sf_dir):
    """One whole tile and a corner have to stay for a pattern to be readable."""
    s = shapes(spark, sf_dir).select("scene").distinct()
    tile = s.withColumn("r", F.explode(F.sequence((F.col("scene") % 3).cast("int"), (F.col("scene") % 3).cast("int") + 2))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return tile.union(s.select("scene", F.lit(5).alias("r"), F.lit(5).alias("c"))).distinct()


@query(with_sql("grid", query="SELECT a.r, a.c, coalesce(a.v, b.v) AS v FROM grid a LEFT JOIN (SELECT r % 4 AS tr, c % 3 AS tc, round(avg(v), 4) AS v FROM grid GROUP BY ALL) b ON a.r % 4 = b.tr AND a.c % 3 = b.tc"))
def pattern_tile_join(spark, sf_dir):
    """Missing cells are filled from the tile that repeats every 4 x 3 cells."""
    g = derive.grid(spark, sf_dir)
    tile = g.groupBy((F.col("r") % 4).alias("tr"), (F.col("c") % 3).alias("tc")).agg(F.round(F.avg("v"), 4).alias("tv"))
    return g.join(F.broadcast(tile), (F.col("r") % 4 == F.col("tr")) & (F.col("c") % 3 == F.col("tc")), "left").select("r", "c", F.coalesce("v", "tv").alias("v"))  # 12 rows
