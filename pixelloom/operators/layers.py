"""Pixel layers: resampled reflections, strokes, primitives of several kinds rasterised in one pass, and the layout of colour keys.

Everything is exploded over its own box, or the part of it that a stroke can touch, never over a canvas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from .scene import dealt

CHANNELS = ("r", "g", "b", "mask")


def _steps(lo: Column, hi: Column) -> Column:
    """Integers from ``lo`` to ``hi``, none if the order is wrong."""
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def _around(at: Column, reach: float, size: int) -> Column:
    """Pixels of a canvas whose centres are within ``reach`` of ``at`` along one side."""
    return _steps(F.greatest(F.lit(0), F.ceil(at - 0.5 - reach)), F.least(F.lit(size - 1), F.floor(at - 0.5 + reach)))


def reflected(layer: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """scene, cx, cy, r, g, b, mask of a layer mirrored across its scene's line, where the mirror image's mask isn't 0.

    ``layer``: the pixels of a mask, with colour; all others are black and 0.  ``lines``: scene, ax, ay, bx, by in pixels.  Each pixel is
    mapped back and blends its four neighbours by their distances; pixels of the layer are handed to those they blend into, so nothing is joined.  Neighbours beyond the canvas repeat its edge, pixels that come from beyond it
    are 0.  Values are rounded half up.
    """
    ends = ((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    own = layer.join(lines.hint("merge"), "scene")
    # What blends a pixel lies within one pixel of its mirror image along either side, so within a diagonal of the pixel's own.
    x, y = geo.reflect((F.col("cx") + 0.5, F.col("cy") + 0.5), *ends)
    own = own.select("scene", "ax", "ay", "bx", "by", *CHANNELS, F.col("cx").alias("tx"), F.col("cy").alias("ty"), _around(x, 1.415, size).alias("_xs"), _around(y, 1.415, size).alias("_ys"))
    out = own.withColumn("cx", F.explode("_xs")).withColumn("cy", F.explode("_ys"))
    x, y = geo.reflect((F.col("cx") + 0.5, F.col("cy") + 0.5), *ends)
    out = out.withColumns({"x": F.round(x, 9), "y": F.round(y, 9)}).where((F.col("x") >= 0) & (F.col("x") < size) & (F.col("y") >= 0) & (F.col("y") < size))
    out = out.withColumns({"i": F.floor(F.col("x") - 0.5), "j": F.floor(F.col("y") - 0.5)}).withColumns({"u": F.col("x") - 0.5 - F.col("i"), "v": F.col("y") - 0.5 - F.col("j")})
    edge = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), c)).cast("int")
    taps = F.array(*(F.struct(edge(F.col("i") + a).alias("tx"), edge(F.col("j") + b).alias("ty"), ((F.col("u") if a else 1 - F.col("u")) * (F.col("v") if b else 1 - F.col("v"))).alias("k")) for a in (0, 1) for b in (0, 1)))
    taken = out.select("scene", "cx", "cy", "tx", "ty", *CHANNELS, F.explode(taps).alias("t")).where("t.tx = tx AND t.ty = ty AND t.k > 0")
    mixed = taken.groupBy("scene", "cx", "cy").agg(*(F.floor(F.round(F.sum(F.col("t.k") * F.col(c)), 6) + 0.5).cast("int").alias(c) for c in CHANNELS))
    return mixed.where("mask > 0")


def rotated(layer: DataFrame, turns: DataFrame, size: int, values: list[str]) -> DataFrame:
    """scene, cx, cy and ``values`` of a layer turned counter-clockwise, each pixel taken from the nearest of the layer; what comes from nowhere is left out.

    ``turns``: scene, degrees, ox, oy (the centre, in pixels).  Every pixel is handed to those that show it, so pixels aren't joined with pixels.  By quarter turns about the middle of the canvas pixels are moved whole.
    """
    centre = (F.col("ox"), F.col("oy"))
    own = layer.join(turns.hint("merge"), "scene")
    # A pixel's centre comes from within the pixel it is taken from, so it lies within half a diagonal of where that one's centre goes.
    x, y = geo.rotate((F.col("cx") + 0.5, F.col("cy") + 0.5), centre, -F.col("degrees"))
    own = own.select("scene", "degrees", "ox", "oy", F.col("cx").alias("sx"), F.col("cy").alias("sy"), *values, _around(x, 0.708, size).alias("_xs"), _around(y, 0.708, size).alias("_ys"))
    out = own.withColumn("cx", F.explode("_xs")).withColumn("cy", F.explode("_ys"))
    x, y = geo.rotate((F.col("cx") + 0.5, F.col("cy") + 0.5), centre, F.col("degrees"))
    near = lambda v: F.floor(F.round(v, 9)).cast("int")
    return out.where((near(x) == F.col("sx")) & (near(y) == F.col("sy"))).select("scene", "cx", "cy", *values)


def pasted(below: Column, above: Column, mask: Column) -> Column:
    """A channel of a layer over another by an 8-bit mask, rounded to nearest."""
    return F.floor((above * mask + below * (255 - mask) + 127) / 255).cast("int")


def distance_to_segment(x: Column, y: Column, a: geo.Point, b: geo.Point) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.coalesce(((x - a[0]) * dx + (y - a[1]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(x - (a[0] + t * dx), F.lit(2)) + F.pow(y - (a[1] + t * dy), F.lit(2)))


def stroked(segments: DataFrame, keys: list[str], width: float, *, step: float, cells: int) -> DataFrame:
    """keys, cx, cy, d: cells whose centres are within half of ``width`` of a segment (ax, ay, bx, by), and the least distance.

    A segment is cut by rows of cells first; in a row only the cells beside the part of the segment that is near the row are looked at, so that
    a long slanted segment costs its length, not its box.
    """
    r, mid = width / 2, step / 2
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    low = lambda v: F.greatest(F.lit(0), F.ceil((v - r - mid) / step))
    high = lambda v: F.least(F.lit(cells - 1), F.floor((v + r - mid) / step))
    rows = segments.select(*keys, "ax", "ay", "bx", "by", F.explode(_steps(low(F.least(ay, by)), high(F.greatest(ay, by)))).alias("cy"))
    y = F.col("cy") * step + mid
    at = lambda v: F.coalesce((v - ay) / F.nullif(by - ay, F.lit(0.0)), F.lit(None).cast("double"))
    cut = lambda t: ax + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (bx - ax)
    near = F.when(by == ay, F.struct(F.least(ax, bx).alias("lo"), F.greatest(ax, bx).alias("hi"))).otherwise(F.struct(F.least(cut(at(y - r)), cut(at(y + r))).alias("lo"), F.greatest(cut(at(y - r)), cut(at(y + r))).alias("hi")))
    touched = rows.withColumn("_near", near).withColumn("cx", F.explode(_steps(low(F.col("_near.lo")), high(F.col("_near.hi")))))
    d = distance_to_segment(F.col("cx") * step + mid, y, (ax, ay), (bx, by))
    return touched.withColumn("d", d).where(F.col("d") <= r).groupBy(*keys, "cx", "cy").agg(F.min("d").alias("d"))


# -- primitives --------------------------------------------------------------------------------------

PRIMITIVE = "ord int, kind string, x0 double, y0 double, x1 double, y1 double, width double, color string"
#: An arrow: its shaft ends at this share of the length and is this wide, of the head's width.
SHAFT, NECK = 0.6, 0.4


#: Primitives that a task draws: each makes up to thousands of pixels.
PRIMITIVES_A_TASK = 5000


def rasterised(primitives: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key, px, py, color of the topmost primitive at each pixel."""
    return drawn(primitives, key, width, height).groupBy(key, "px", "py").agg(F.max_by("color", "ord").alias("color"))


def drawn(primitives: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """``primitives``, dealt by ``key``, x their pixels (px, py).

    ``rect`` fills its corners' pixels and all between; ``frame`` is the border of one, ``width`` wide, inside; ``line`` reaches half of ``width`` around its
    segment; ``arrow_h`` points right and ``arrow_v`` down in the box of its corners, by pixel centres.
    """
    x0, y0, x1, y1, w = (F.col(c) for c in ("x0", "y0", "x1", "y1", "width"))
    pad = F.when(F.col("kind") == "line", F.ceil(w / 2)).otherwise(F.lit(0))
    span = lambda a, b, size: _steps(F.greatest(F.lit(0), F.floor(F.least(a, b)) - pad), F.least(F.lit(size - 1), F.ceil(F.greatest(a, b)) + pad))
    at = dealt(primitives, PRIMITIVES_A_TASK, key).withColumn("px", F.explode(span(x0, x1, width))).withColumn("py", F.explode(span(y0, y1, height)))
    x, y = F.col("px"), F.col("py")
    inside = x.between(x0, x1) & y.between(y0, y1)
    border = (x < x0 + w) | (x > x1 - w) | (y < y0 + w) | (y > y1 - w)

    def arrow(along: Column, a0: Column, a1: Column, across: Column, c0: Column, c1: Column) -> Column:
        u, v = (along + 0.5 - a0) / (a1 - a0), F.abs((across + 0.5 - c0) / (c1 - c0) - 0.5)
        return u.between(0, 1) & F.when(u < SHAFT, v <= NECK / 2).otherwise(v <= (1 - u) / (1 - SHAFT) / 2)

    hit = (
        F.when(F.col("kind") == "rect", inside).when(F.col("kind") == "frame", inside & border)
        .when(F.col("kind") == "line", distance_to_segment(x.cast("double"), y.cast("double"), (x0, y0), (x1, y1)) <= w / 2)
        .when(F.col("kind") == "arrow_h", arrow(x, x0, x1, y, y0, y1)).when(F.col("kind") == "arrow_v", arrow(y, y0, y1, x, x0, x1)).otherwise(F.lit(False))
    )
    return at.where(hit)


def flowed(items: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """``items`` with ``begin`` and ``middle`` along a line: each starts where those before it end."""
    before = F.sum("_size").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = items.withColumn("_size", size).withColumn("begin", F.coalesce(before, F.lit(0.0)))
    return out.withColumn("middle", F.col("begin") + F.col("_size") / 2).drop("_size")


def key_strips(entries: DataFrame, key: str, *, width: int, height: int, strip: int, ground: str = "white", border: str = "black", cross: str = "x") -> DataFrame:
    """Primitives (``key`` and those of ``PRIMITIVE``) of colour keys along one side of a canvas.

    ``entries``: key, side (top, bottom, left or right), i (their order), source, target (null: an X).  An entry is a swatch, an arrow and another
    swatch or a crossed box; entries share the side evenly.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    flat = F.col("side").isin("top", "bottom")
    own = entries.withColumn("_n", n).withColumn("_span", F.when(flat, F.lit(width)).otherwise(F.lit(height)) / F.col("_n"))
    own = flowed(own, key, "i", F.col("_span"))
    sw = F.greatest(F.lit(8), F.least(F.lit(int(strip * 0.40)), F.floor(F.col("_span") / 4.0))).cast("int")
    own = own.withColumn("_sw", sw).withColumns({"_cc": F.floor(F.col("middle")).cast("int"), "_brd": F.greatest(F.lit(1), F.floor(F.col("_sw") / 12)).cast("int")})
    side = lambda **at: F.when(F.col("side") == "top", at["top"]).when(F.col("side") == "bottom", at["bottom"]).when(F.col("side") == "left", at["left"]).otherwise(at["right"])
    mid = side(top=F.lit(strip // 2), bottom=F.lit((2 * height - strip) // 2), left=F.lit(strip // 2), right=F.lit((2 * width - strip) // 2))
    own = own.withColumn("_mid", mid)
    cc, s, m, brd = F.col("_cc"), F.col("_sw"), F.col("_mid"), F.col("_brd")
    half = F.floor(s / 2).cast("int")
    first, second, across = cc - half - s, cc + half, m - half

    def made(ord_: int, kind: Column | str, along: tuple[Column, Column], over: tuple[Column, Column], w: Column, color: Column) -> Column:
        """A primitive given along and across the strip."""
        d = lambda c: c.cast("double")
        pick = lambda a, b: F.when(flat, d(a)).otherwise(d(b))
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct((F.col("i") * 10 + ord_).cast("int").alias("ord"), kind.alias("kind"), pick(along[0], over[0]).alias("x0"), pick(over[0], along[0]).alias("y0"), pick(along[1], over[1]).alias("x1"), pick(over[1], along[1]).alias("y1"), d(w).alias("width"), color.alias("color"))

    a0, a1 = first + s + 1, second - 1
    length = a1 - a0
    thick = F.greatest(F.lit(4), F.least(F.floor(length / 2), F.floor(s / 2))).cast("int")
    # A lying arrow fills its box; a standing one is turned about its centre, which its odd sizes shift by half a pixel.
    low = F.floor(thick / 2)
    shift = a1 - low - F.floor(length / 2) + thick / 2 - length / 2
    pad, line = F.greatest(F.lit(2), F.floor(s / 5)), F.greatest(F.lit(2), F.floor(s / 6))
    inner, outer = second + pad, second + s - 1 - pad
    box = (across, across + s - 1)
    none = F.lit(None)
    crossed = F.col("target").isNull()
    parts = F.array(
        made(1, "rect", (first, first + s - 1), box, brd, F.col("source")), made(2, "frame", (first, first + s - 1), box, brd, F.lit(border)),
        F.when(length >= 4, F.when(flat, made(3, "arrow_h", (a0, a1), (m - low, m - low + thick), brd, F.lit(border))).otherwise(
            made(3, "arrow_v", (shift, shift + length), (m - F.floor(length / 2) + length / 2 - thick / 2, m - F.floor(length / 2) + length / 2 + thick / 2), brd, F.lit(border)))),
        made(4, "rect", (second, second + s - 1), box, brd, F.coalesce("target", F.lit(ground))), made(5, "frame", (second, second + s - 1), box, brd, F.lit(border)),
        F.when(crossed, made(6, "line", (inner, outer), (across + pad, across + s - 1 - pad), line, F.lit(cross))).otherwise(none),
        F.when(crossed, made(7, "line", (outer, inner), (across + pad, across + s - 1 - pad), line, F.lit(cross))).otherwise(none),
    )
    drawn = own.select(key, F.explode(F.array_compact(parts)).alias("p")).select(key, "p.*")
    boxes = {"top": (0, 0, width - 1, strip - 1), "bottom": (0, height - strip, width - 1, height - 1), "left": (0, 0, strip - 1, height - 1), "right": (width - strip, 0, width - 1, height - 1)}
    corner = lambda k: side(**{s_: F.lit(float(b[k])) for s_, b in boxes.items()})
    ground_ = entries.select(key, "side").distinct().select(key, F.lit(-1).alias("ord"), F.lit("rect").alias("kind"), *(corner(k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), F.lit(0.0).alias("width"), F.lit(ground).alias("color"))
    return drawn.unionByName(ground_)
