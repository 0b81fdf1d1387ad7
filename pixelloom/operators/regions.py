"""Regions of scenes: convex hulls, coverage by shapes, regions found by rejection, control points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as geo
from ..functions import keyed
from ..sources.shared import stored
from . import sampling
from . import scene as sc

POINTS = "array<struct<x:double,y:double>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def hull(points: Column) -> Column:
    """Convex hull of an array of points (x, y), counter-clockwise from the least, without repeated and collinear points.

    Two folds over the sorted points.  A point cuts its chain back to the last place from which it lies to the left, so the fold's state is the chain.
    """
    def add(chain: Column, p: Column) -> Column:
        keeps = F.filter(F.sequence(F.lit(2), F.size(chain)), lambda k: _cross(F.element_at(chain, k - 1), F.element_at(chain, k), p) > 0)
        return F.when(F.size(chain) < 2, F.concat(chain, F.array(p))).otherwise(F.concat(F.slice(chain, F.lit(1), F.coalesce(F.array_max(keeps), F.lit(1))), F.array(p)))

    def half(seq: Column) -> Column:
        chain = F.aggregate(seq, F.array().cast(POINTS), add)
        return bound(chain, lambda c: F.slice(c, F.lit(1), F.size(c) - 1))

    return bound(F.array_sort(F.array_distinct(points.cast(POINTS))), lambda p: F.when(F.size(p) < 3, p).otherwise(F.concat(half(p), half(F.reverse(p)))))


def hulls(points: DataFrame, key: str, x: str, y: str, pieces: int = 16) -> DataFrame:
    """``key`` and ``hull`` of its points.  A key's points are dealt to pieces by hash; only the corners of the pieces' hulls come together."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("p"))
    part = p.groupBy(key, F.pmod(F.xxhash64("p"), F.lit(pieces)).alias("_piece")).agg(hull(F.collect_set("p")).alias("h"))
    return part.groupBy(key).agg(hull(F.flatten(F.collect_list("h"))).alias("hull"))


def edges(polygon: Column) -> Column:
    """Array of (a, b): a polygon's edges in order."""
    ends = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, F.lit(1), F.lit(1)))
    return F.arrays_zip(polygon.alias("a"), ends.alias("b"))


def spans(polygon: Column) -> Column:
    """Array of (cy, lo, hi): the runs of cells of a convex polygon, one a row of cells, empty rows left out.

    A cell is inside by the even-odd rule at its centre, so a row's cells are those between its two crossings.
    """
    mid, last = sc.STEP / 2, sc.CELLS - 1
    row = lambda v: F.greatest(F.lit(0), F.least(F.lit(last), v)).cast("int")
    ys = F.transform(polygon, lambda p: p["y"])
    rows = F.sequence(row(F.floor((F.array_min(ys) - mid) / sc.STEP)), row(F.ceil((F.array_max(ys) - mid) / sc.STEP)))

    def run(of: Column) -> Callable[[Column], Column]:
        def at(cy: Column) -> Column:
            y = cy * sc.STEP + mid
            xs = F.transform(F.filter(of, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)), lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]))
            # The first cell whose centre isn't left of a crossing.
            cell = lambda x: F.ceil((x - mid) / sc.STEP).cast("int")
            return bound(xs, lambda v: F.struct(cy.alias("cy"), F.greatest(F.lit(0), cell(F.array_min(v))).alias("lo"), F.when(F.size(v) == 0, -1).otherwise(F.least(F.lit(last), cell(F.array_max(v)) - 1)).alias("hi")))
        return at

    every = F.when(F.size(polygon) < 3, F.array().cast("array<struct<cy:int,lo:int,hi:int>>")).otherwise(bound(edges(polygon), lambda of: F.transform(rows, run(of))))
    return F.filter(every, lambda s: s["lo"] <= s["hi"])


#: Attempts that a task makes: each takes a fraction of a millisecond, and a scene is few bytes.
ATTEMPTS_A_TASK = 8000


def covered(regions: DataFrame, canvases: DataFrame, polygon: str) -> DataFrame:
    """``regions`` with n_cells and n_covered (cells of ``polygon`` that shapes cover): bits of its runs of cells against those of its scene's ``canvas``."""
    own = regions.join(canvases.hint("shuffle_hash"), "scene").withColumn("_spans", spans(F.col(polygon)))
    n = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["hi"] - s["lo"] + 1)
    on = F.aggregate("_spans", F.lit(0), lambda n, s: n + F.bit_count(F.col("canvas")[s["cy"]].bitwiseAND(sc.bits(s["lo"], s["hi"]))))
    return own.withColumns({"n_cells": n, "n_covered": on}).drop("_spans", "canvas")


def found_regions(shapes: DataFrame, propose: Callable[[DataFrame], DataFrame], *, limit: int, least_shape: float = 0.05, least_ground: float = 0.10, name: str = "region") -> DataFrame:
    """A row a scene: scene, t, ok, polygon, n_cells, n_covered and whatever else ``propose`` adds as ``note``.

    ``propose`` gets (scene, t), dealt by scene, and adds ``polygon`` (convex) and ``note``.  The first attempt with enough of shapes and of ground in it is
    taken; of ``limit`` bad ones the last is, with ok false.
    """
    canvases = stored(sc.masks(shapes, canvas=F.lit(True)), f"{name}-canvas")

    def advance(rows: DataFrame, lo: int, hi: int) -> DataFrame:
        own = sc.dealt(rows.select("scene"), max(1, ATTEMPTS_A_TASK // (hi - lo)), "scene")
        seen = covered(propose(own.withColumn("t", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))), canvases, "polygon")
        n, on = F.col("n_cells"), F.col("n_covered")
        seen = seen.withColumn("ok", (n > 0) & (on >= n * least_shape) & (n - on >= n * least_ground))
        best = F.min_by(F.struct("t", "ok", "polygon", "n_cells", "n_covered", "note"), F.when(F.col("ok"), F.col("t")).otherwise(2 * limit - F.col("t")))
        return seen.groupBy("scene").agg(best.alias("best")).select("scene", "best.*")

    start = canvases.selectExpr("scene", "-1 AS t", "false AS ok", f"CAST(array() AS {POINTS}) AS polygon", "0 AS n_cells", "0 AS n_covered", "-1L AS note")
    return sampling.in_waves(start, advance, ~F.col("ok"), first=4, limit=limit, name=name)


MARGIN = 0.04


def around_shape(shapes: DataFrame, *, points: int = 12, width: int = sc.CANVAS, height: int = sc.CANVAS) -> Callable[[DataFrame], DataFrame]:
    """Proposals: the hull of one shape's box and of points scattered around it; ``note`` is the shape's z.

    The shape is drawn evenly among its scene's, by its place in z order.
    """
    row = F.struct("z", *(F.col(c).cast("double").alias(c) for c in "xywh"))
    scenes = sc.dealt(shapes, sc.SHAPES_A_TASK, "scene").groupBy("scene").agg(F.sort_array(F.collect_list(row)).alias("_all"))

    def propose(tries: DataFrame) -> DataFrame:
        h = keyed.digest(F.lit("region"), F.col("scene"), F.col("t"))
        own = tries.join(scenes.hint("shuffle_hash"), "scene").withColumn("_h", h)
        own = own.withColumn("_s", F.element_at("_all", keyed.pick(F.col("_h"), F.size("_all")) + 1)).select("scene", "t", "_h", "_s.*")
        pad = F.greatest((keyed.share(F.col("_h"), 1) * 0.5 + 0.3) * F.greatest("w", "h"), F.lit(0.05 * min(width, height)))
        own = own.withColumn("_pad", pad)
        x, y, w, ht, p = (F.col(c) for c in ("x", "y", "w", "h", "_pad"))
        lo = lambda a, size: F.greatest(F.lit(MARGIN * size), a - p)
        hi = lambda a, s, size: F.least(F.lit((1 - MARGIN) * size), a + s + p)
        own = own.withColumns({"_x0": lo(x, width), "_x1": hi(x, w, width), "_y0": lo(y, height), "_y1": hi(y, ht, height)})
        drawn = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: keyed.digest(F.lit("region"), F.col("scene"), F.col("t"), i))
        at = lambda c, u: F.col(f"_{c}0") + u * (F.col(f"_{c}1") - F.col(f"_{c}0"))
        scattered = F.transform(drawn, lambda d: F.struct(at("x", keyed.share(d, 0)).alias("x"), at("y", keyed.share(d, 1)).alias("y")))
        corners = F.array(*(F.struct((x + u * w).alias("x"), (y + v * ht).alias("y")) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))))
        return own.select("scene", "t", hull(F.concat(corners, scattered)).alias("polygon"), F.col("z").cast("long").alias("note"))

    return propose


def parallelogram(hashed: Column, width: int, height: int, horizontal: Column) -> dict[str, Column]:
    """A parallelogram drawn from a hash: its centre, half sides and slant; lying (straight top and bottom) or standing."""
    u = [keyed.share(hashed, k) for k in range(5)]
    long_, short = (lambda v, size: (v * 0.18 + 0.18) * size), (lambda v, size: (v * 0.10 + 0.06) * size)
    return {
        "cx": (u[0] * 0.4 + 0.3) * width, "cy": (u[1] * 0.4 + 0.3) * height,
        "hw": F.when(horizontal, long_(u[2], width)).otherwise(short(u[2], width)), "hh": F.when(horizontal, short(u[3], height)).otherwise(long_(u[3], height)),
        "slant": (u[4] * 0.24 - 0.12) * F.when(horizontal, F.lit(width)).otherwise(F.lit(height)),
    }


def corner_offsets(horizontal: Column, hw: Column, hh: Column, slant: Column) -> Column:
    """Array of (x, y) from the centre, clockwise from the upper left."""
    def corner(sx: int, sy: int) -> Column:
        return F.struct((hw * sx + F.when(horizontal, slant * -sy).otherwise(0.0)).alias("x"), (hh * sy + F.when(horizontal, 0.0).otherwise(slant * -sx)).alias("y"))

    return F.array(*(corner(sx, sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def feasible_scale(offsets: Column, cx: Column, cy: Column, width: int, height: int, margin: float = MARGIN) -> Column:
    """The largest factor, at most 1, by which offsets from a centre stay within the canvas less its margin.

    Each corner and each side of the canvas is one ratio of distances; their minimum is exact, so nothing is tried.
    """
    def ratio(d: Column, c: Column, size: int) -> Column:
        room = F.when(d > 0, F.lit((1 - margin) * size) - c).otherwise(c - margin * size)
        return F.when(d == 0, F.lit(1.0)).otherwise(room / F.abs(d))

    return F.aggregate(offsets, F.lit(1.0), lambda s, o: F.least(s, ratio(o["x"], cx, width), ratio(o["y"], cy, height)))


def clamped(offsets: Column, cx: Column, cy: Column, width: int, height: int, margin: float = MARGIN) -> Column:
    """Corners with each coordinate moved into the canvas less its margin on its own."""
    into = lambda v, size: F.greatest(F.lit(margin * size), F.least(F.lit((1 - margin) * size), v))
    return F.transform(offsets, lambda o: F.struct(into(cx + o["x"], width).alias("x"), into(cy + o["y"], height).alias("y")))


def slanted(width: int = sc.CANVAS, height: int = sc.CANVAS) -> Callable[[DataFrame], DataFrame]:
    """Proposals: parallelograms scaled into the canvas, lying in even scenes; ``note`` is 0 or 1 by that."""
    def propose(tries: DataFrame) -> DataFrame:
        lying = F.col("scene") % 2 == 0
        own = tries.withColumn("_h", keyed.digest(F.lit("slanted"), F.col("scene"), F.col("t"))).withColumns(parallelogram(F.col("_h"), width, height, lying))
        own = own.withColumn("_o", corner_offsets(lying, F.col("hw"), F.col("hh"), F.col("slant")))
        own = own.withColumn("_s", feasible_scale(F.col("_o"), F.col("cx"), F.col("cy"), width, height))
        at = lambda o: F.struct((F.col("cx") + o["x"] * F.col("_s")).alias("x"), (F.col("cy") + o["y"] * F.col("_s")).alias("y"))
        return own.select("scene", "t", F.transform("_o", at).alias("polygon"), (F.col("scene") % 2).cast("long").alias("note"))

    return propose


# -- control points --------------------------------------------------------------------------------

_BOX = {"center": (0.5, 0.5), "top-left corner": (0.0, 0.0), "top-right corner": (1.0, 0.0), "bottom-right corner": (1.0, 1.0), "bottom-left corner": (0.0, 1.0)}
_EDGES = {"top edge midpoint": (0.5, 0.0), "bottom edge midpoint": (0.5, 1.0), "left edge midpoint": (0.0, 0.5), "right edge midpoint": (1.0, 0.5)}
_ROUND = {"center": (0.5, 0.5), "rightmost point": (1.0, 0.5), "leftmost point": (0.0, 0.5), "highest point": (0.5, 0.0), "lowest point": (0.5, 1.0)}


def _vertices(n: int) -> dict[str, tuple[float, float]]:
    return {"center": (0.5, 0.5), **{f"vertex {k + 1}": p for k, p in enumerate(geo.unit(geo.ngon(n)))}}


CANVAS_SOURCE = "canvas"
#: Named points of each kind of source, in the unit square of its box.
CONTROL_POINTS: dict[str, dict[str, tuple[float, float]]] = {
    CANVAS_SOURCE: _BOX | _EDGES, "square": _BOX | _EDGES, "circle": _ROUND, "ring": _ROUND, "diamond": _ROUND, "triangle": _vertices(3), "pentagon": _vertices(5), "hexagon": _vertices(6),
    **{s: {"center": (0.5, 0.5)} for s in dims.SHAPES if s in ("star", "heart", "arrow", "cross", "semicircle")},
}


def control_dim(spark) -> DataFrame:
    """shape, name, u, v: some sixty rows."""
    return spark.createDataFrame([(s, n, float(u), float(v)) for s, own in CONTROL_POINTS.items() for n, (u, v) in own.items()], "shape string, name string, u double, v double")


def drawn_control_points(shapes: DataFrame, draw: str, *, exclude: DataFrame | None = None, width: int = sc.CANVAS, height: int = sc.CANVAS) -> DataFrame:
    """scene, z (null: the canvas), name, px, py: one control point a scene.

    A source is drawn with equal chance whatever its number of points, the canvas being one more, then a point of it: the least by hash, in one
    aggregation that combines before the shuffle.  ``exclude``: (scene, z, name) pairs that aren't drawn; the next of that source by hash is, and without one the next source.
    """
    canvas = shapes.select("scene").distinct().selectExpr("scene", "CAST(NULL AS INT) AS z", f"'{CANVAS_SOURCE}' AS shape", "0D AS x", "0D AS y", f"{float(width)}D AS w", f"{float(height)}D AS h", "0 AS rotation")
    own = shapes.select("scene", "z", "shape", *(F.col(c).cast("double").alias(c) for c in "xywh"), F.col("rotation").cast("int").alias("rotation")).unionByName(canvas)
    p = own.join(F.broadcast(control_dim(shapes.sparkSession)), "shape")  # some sixty rows
    if exclude is not None:
        gone = exclude.select("scene", F.col("z").alias("_z"), F.col("name").alias("_name"))
        p = p.alias("p").join(gone, (F.col("p.scene") == gone["scene"]) & F.col("p.z").eqNullSafe(gone["_z"]) & (F.col("p.name") == gone["_name"]), "left_anti")
    x, y = geo.rotate(geo.scale_into((F.col("u"), F.col("v")), sc.box()), sc.centre(), F.col("rotation"))
    source = F.coalesce(F.col("z"), F.lit(-1))
    order = F.struct(keyed.digest(F.lit(draw), F.col("scene"), source), source, keyed.digest(F.lit(draw), F.col("scene"), source, F.col("name")), "name")
    return p.groupBy("scene").agg(F.min_by(F.struct("z", "name", x.alias("px"), y.alias("py")), order).alias("c")).select("scene", "c.*")
