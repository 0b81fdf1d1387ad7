"""Queries: hulls, regions around shapes, parallelograms, control points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keyed
from ..operators import regions
from ..operators import scene as sc
from ..registry import query
from . import derive, q_scenes  # noqa: F401  q_scenes adds the SQL of cells
from .derive import SQL, with_sql

S, N, W = sc.STEP, sc.CELLS, sc.CANVAS
TRIES, SLANTED_TRIES = 20, 50


def hull_edges_sql(points: str, keys: str) -> str:
    """Directed edges (p to q) of the hulls of ``points`` (keys, x, y), by the definition: no point lies to the right, and those on the line lie between."""
    k = keys.split(", ")
    same = lambda t: " AND ".join(f"p.{c} = {t}.{c}" for c in k)
    own = ", ".join(f"p.{c}" for c in k)
    turn = "(q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)"
    return f"""(SELECT {own}, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM {points} p JOIN {points} q ON {same('q')} AND (p.x <> q.x OR p.y <> q.y) JOIN {points} r ON {same('r')} GROUP BY ALL
        HAVING min({turn}) >= 0 AND max(CASE WHEN {turn} = 0 THEN (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) ELSE 0 END) <= 0)"""


def _ring_sql(edges: str, keys: str) -> str:
    """Corners of hulls in order: the least, then by angle around it."""
    return f"""(SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN ax = low.x AND ay = low.y THEN -9 ELSE atan2(ay - low.y, ax - low.x) END) - 1 AS k, ax AS x, ay AS y
        FROM (SELECT *, min({{'x': ax, 'y': ay}}) OVER (PARTITION BY {keys}) AS low FROM {edges}))"""


@query(with_sql("shapes", query=f"""SELECT scene, k::INT AS k, x, y FROM (WITH c AS (SELECT DISTINCT scene, x + w / 2.0e0 AS x, y + h / 2.0e0 AS y FROM shapes), e AS {hull_edges_sql('c', 'scene')} SELECT * FROM {_ring_sql('e', 'scene')})"""))
def convex_hull(spark, sf_dir):
    """Hull of each scene's centres, corner by corner."""
    cx, cy = sc.centre()
    own = regions.hulls(derive.shapes(spark, sf_dir).select("scene", cx.alias("cx"), cy.alias("cy")), "scene", "cx", "cy")
    return own.select("scene", F.posexplode("hull").alias("k", "p")).select("scene", "k", "p.x", "p.y")


def _share(name: str, k: int, *parts: str) -> str:
    return keyed.sql_share(keyed.sql_digest(f"'{name}'", *parts), k)


_CENTS = "string_agg(round(x * 100)::BIGINT || ' ' || round(y * 100)::BIGINT, ';' ORDER BY k)"


def _judged_sql(tries: str, limit: int) -> str:
    """From edges (scene, t, note, ax, ay, bx, by_) and corners: the first region with enough in it, else the last, by testing every cell."""
    return f"""ins AS (SELECT scene, t, cx, cy FROM (SELECT *, cx * {S} + {S // 2} AS px, cy * {S} + {S // 2} AS py FROM edge, range(0, {N}) a(cx), range(0, {N}) b(cy)) GROUP BY ALL
        HAVING (count(*) FILTER (WHERE (ay > py) <> (by_ > py) AND px < ax + (py - ay) / (by_ - ay) * (bx - ax))) % 2 = 1),
    cov AS (SELECT t.scene, t.t, t.note, count(i.cx) AS n, count(c.cx) AS k FROM {tries} t LEFT JOIN ins i ON t.scene = i.scene AND t.t = i.t LEFT JOIN (SELECT DISTINCT scene, cx, cy FROM cells) c ON i.scene = c.scene AND i.cx = c.cx AND i.cy = c.cy GROUP BY ALL),
    ok AS (SELECT *, n > 0 AND k >= n * 0.05e0 AND n - k >= n * 0.1e0 AS ok FROM cov),
    best AS (SELECT scene, arg_min({{'t': t, 'ok': ok, 'note': note, 'n': n, 'k': k}}, CASE WHEN ok THEN t ELSE {2 * limit} - t END) AS b FROM ok GROUP BY scene)
    SELECT best.scene, b.t::INT AS t, b.ok AS ok, b.note::BIGINT AS note, b.n::INT AS n_cells, b.k::INT AS n_covered, outline FROM best JOIN (SELECT scene, t, {_CENTS} AS outline FROM ring GROUP BY ALL) o ON best.scene = o.scene AND b.t = o.t"""


def _outlined(found):
    cents = lambda p: F.concat_ws(" ", F.round(p["x"] * 100).cast("long").cast("string"), F.round(p["y"] * 100).cast("long").cast("string"))
    return found.select("scene", "t", "ok", "note", "n_cells", "n_covered", F.array_join(F.transform("polygon", cents), ";").alias("outline"))


@query(with_sql("shapes", "cells", query=f"""SELECT * FROM (WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY z) - 1 AS place, count(*) OVER (PARTITION BY scene) AS n FROM shapes),
    tries AS (SELECT scene, t, z AS note, x, y, w, h, greatest(({_share('region', 1, 'scene', 't')} * 0.5e0 + 0.3e0) * greatest(w, h), {0.05 * W}e0) AS pad
        FROM ranked, range(0, {TRIES}) x(t) WHERE place = floor({_share('region', 0, 'scene', 't')} * n)),
    box AS (SELECT *, greatest({0.04 * W}e0, x - pad) AS x0, least({0.96 * W}e0, x + w + pad) AS x1, greatest({0.04 * W}e0, y - pad) AS y0, least({0.96 * W}e0, y + h + pad) AS y1 FROM tries),
    pts AS (SELECT scene, t, x0 + {_share('region', 0, 'scene', 't', 'i')} * (x1 - x0) AS x, y0 + {_share('region', 1, 'scene', 't', 'i')} * (y1 - y0) AS y FROM box, range(0, 12) r(i)
        UNION SELECT scene, t, (x + u * w)::DOUBLE, (y + v * h)::DOUBLE FROM tries, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) c(u, v)),
    edge AS MATERIALIZED {hull_edges_sql('pts', 'scene, t')}, ring AS {_ring_sql('edge', 'scene, t')}, {_judged_sql('tries', TRIES)})"""))
def shape_regions(spark, sf_dir):
    """A convex region around one of a scene's shapes, at the first of 20 attempts that has shapes and ground enough in it (else the last): note is the shape's z."""
    s = derive.shapes(spark, sf_dir)
    return _outlined(regions.found_regions(s, regions.around_shape(s), limit=TRIES))


_LYING = "scene % 2 = 0"


def _slanted_sql(tag: str, keys: str) -> str:
    """Drawn parallelograms: centre, offsets of four corners, scale."""
    u = [_share(tag, k, *keys.split(", ")) for k in range(5)]
    side = lambda v, a, b: f"CASE WHEN {_LYING} THEN {a} ELSE {b} END".replace("@", v)
    room = lambda d, c: f"CASE WHEN {d} = 0 THEN 1e0 ELSE CASE WHEN {d} > 0 THEN {0.96 * W!r}e0 - {c} ELSE {c} - {0.04 * W!r}e0 END / abs({d}) END"
    return f"""(SELECT *, min(least(1e0, {room('ox', 'cx')}, {room('oy', 'cy')})) OVER (PARTITION BY {keys}) AS s FROM (
        SELECT *, hw * sx + CASE WHEN {_LYING} THEN slant * -sy ELSE 0 END AS ox, hh * sy + CASE WHEN {_LYING} THEN 0 ELSE slant * -sx END AS oy FROM (
        SELECT *, ({u[0]} * 0.4e0 + 0.3e0) * {W} AS cx, ({u[1]} * 0.4e0 + 0.3e0) * {W} AS cy, {side(u[2], '(@ * 0.18e0 + 0.18e0)', '(@ * 0.1e0 + 0.06e0)')} * {W} AS hw,
            {side(u[3], '(@ * 0.1e0 + 0.06e0)', '(@ * 0.18e0 + 0.18e0)')} * {W} AS hh, ({u[4]} * 0.24e0 - 0.12e0) * {W} AS slant FROM src), (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(k, sx, sy)))"""


@query(with_sql("shapes", query=f"""SELECT scene, k::INT AS k, round(s, 9) AS scale, round(cx + ox * s, 6) AS x, round(cy + oy * s, 6) AS y,
    round(greatest({0.04 * W!r}e0, least({0.96 * W!r}e0, cx + ox)), 6) AS clamped_x, round(greatest({0.04 * W!r}e0, least({0.96 * W!r}e0, cy + oy)), 6) AS clamped_y
    FROM (WITH src AS (SELECT DISTINCT scene FROM shapes) SELECT * FROM {_slanted_sql('fit', 'scene')})"""))
def fitted_parallelograms(spark, sf_dir):
    """A slanted region a scene, brought into the canvas by its largest feasible scale, and corner by corner."""
    lying = F.col("scene") % 2 == 0
    own = derive.shapes(spark, sf_dir).select("scene").distinct().withColumn("h", keyed.digest(F.lit("fit"), F.col("scene")))
    own = own.withColumns(regions.parallelogram(F.col("h"), W, W, lying)).withColumn("o", regions.corner_offsets(lying, F.col("hw"), F.col("hh"), F.col("slant")))
    own = own.withColumns({"s": regions.feasible_scale(F.col("o"), F.col("cx"), F.col("cy"), W, W), "c": regions.clamped(F.col("o"), F.col("cx"), F.col("cy"), W, W)})
    rows = own.select("scene", "s", "cx", "cy", F.posexplode(F.arrays_zip("o", "c")).alias("k", "p"))
    r6 = lambda c: F.round(c, 6)
    return rows.select("scene", "k", F.round("s", 9).alias("scale"), r6(F.col("cx") + F.col("p.o.x") * F.col("s")).alias("x"), r6(F.col("cy") + F.col("p.o.y") * F.col("s")).alias("y"), r6("p.c.x").alias("clamped_x"), r6("p.c.y").alias("clamped_y"))


@query(with_sql("shapes", "cells", query=f"""SELECT * FROM (WITH src AS (SELECT DISTINCT scene, t FROM shapes, range(0, {SLANTED_TRIES}) x(t)), tries AS (SELECT scene, t, scene % 2 AS note FROM src),
    ring AS MATERIALIZED (SELECT scene, t, k, cx + ox * s AS x, cy + oy * s AS y FROM {_slanted_sql('slanted', 'scene, t')}),
    edge AS (SELECT a.scene, a.t, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ring a JOIN ring b ON a.scene = b.scene AND a.t = b.t AND b.k = (a.k + 1) % 4), {_judged_sql('tries', SLANTED_TRIES)})"""))
def slanted_regions(spark, sf_dir):
    """A parallelogram a scene with shapes and ground enough in it, at the first of 50 attempts: note is 1 for standing ones."""
    return _outlined(regions.found_regions(derive.shapes(spark, sf_dir), regions.slanted(), limit=SLANTED_TRIES, name="slanted"))


_DIM = "(VALUES " + ", ".join(f"('{s}', '{n}', {u!r}::DOUBLE, {v!r}::DOUBLE)" for s, own in regions.CONTROL_POINTS.items() for n, (u, v) in own.items()) + ") AS dim_point(shape, name, u, v)"
_SRC = "coalesce(z, -1)"


def _draw_sql(name: str, points: str) -> str:
    order = f"{{'a': {keyed.sql_digest(f"'{name}'", 'scene', _SRC)}, 'b': {_SRC}, 'c': {keyed.sql_digest(f"'{name}'", 'scene', _SRC, 'name')}, 'd': name}}"
    return f"(SELECT scene, arg_min({{'z': z, 'name': name, 'px': px, 'py': py}}, {order}) AS c FROM {points} GROUP BY scene)"


@query(with_sql("shapes", query=f"""SELECT scene, draw, c.z AS z, c.name AS name, round(c.px, 6) AS px, round(c.py, 6) AS py FROM (
    WITH src AS (SELECT scene, z, shape, x, y, w, h, rotation FROM shapes UNION ALL SELECT DISTINCT scene, NULL, '{regions.CANVAS_SOURCE}', 0, 0, {W}, {W}, 0 FROM shapes),
    pts AS (SELECT scene, z, name, mx + (qx - mx) * cos(a) - (qy - my) * sin(a) AS px, my + (qx - mx) * sin(a) + (qy - my) * cos(a) AS py
        FROM (SELECT *, x + u * w AS qx, y + v * h AS qy, x + w / 2e0 AS mx, y + h / 2e0 AS my, radians(rotation::DOUBLE) AS a FROM src JOIN {_DIM} USING (shape))),
    one AS MATERIALIZED {_draw_sql('first', 'pts')},
    two AS {_draw_sql('second', '(SELECT p.* FROM pts p JOIN one o ON p.scene = o.scene WHERE NOT (p.z IS NOT DISTINCT FROM o.c.z AND p.name = o.c.name))')}
    SELECT scene, 1 AS draw, c FROM one UNION ALL SELECT scene, 2, c FROM two)"""))
def control_point_draws(spark, sf_dir):
    """Two different control points a scene: sources (shapes and the canvas) have equal chances, then their points."""
    s = derive.shapes(spark, sf_dir)
    one = regions.drawn_control_points(s, "first")
    two = regions.drawn_control_points(s, "second", exclude=one)
    both = one.withColumn("draw", F.lit(1)).unionByName(two.withColumn("draw", F.lit(2)))
    return both.select("scene", "draw", "z", "name", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))
