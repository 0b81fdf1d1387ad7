"""Queries: rejection loops and keyed draws over scenes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..functions import color, keyed
from ..operators import dressing, sampling
from ..registry import query
from . import derive
from .derive import SQL, with_sql

COLORS, APART, TRIES = 4, 20.0, 500
_C = {"l": f"{keyed.sql_share('h', 0)} * 100", "a": f"{keyed.sql_share('h', 1)} * 200 - 100", "b": f"{keyed.sql_share('h', 2)} * 200 - 100"}
_LAB = color.sql_lab("r", "g", "b")
_X = color.sql_srgb_of_lab("l", "a", "b")
_FAR = f"len(list_filter(s.labs, lambda o: sqrt((o.l - c.l) * (o.l - c.l) + (o.a - c.a) * (o.a - c.a) + (o.b - c.b) * (o.b - c.b)) <= {APART}e0)) = 0"


@query(with_sql("shapes", query=f"""SELECT scene, k, t, red, green, blue FROM (
    WITH RECURSIVE bg AS (SELECT scene, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM (SELECT scene, arg_min(fill, z) AS name FROM shapes GROUP BY scene) JOIN {dims.sql_palette()} USING (name)),
    tries AS (SELECT scene, t::INT AS t, {_C['l']} AS l, {_C['a']} AS a, {_C['b']} AS b FROM (SELECT scene, t, {keyed.sql_digest("'palette'", 'scene', 't')} AS h FROM bg, range(0, {COLORS * TRIES}) x(t))),
    valid AS MATERIALIZED (SELECT scene, t, l, a, b, x1, x2, x3 FROM (SELECT *, {_X[0]} AS x1, {_X[1]} AS x2, {_X[2]} AS x3 FROM tries) WHERE least(x1, x2, x3) >= -1e-6 AND greatest(x1, x2, x3) <= 1 + 1e-6),
    sel AS (SELECT scene, -1 AS k, -1 AS t, [{{'l': l, 'a': a, 'b': b}}] AS labs, 0e0 AS x1, 0e0 AS x2, 0e0 AS x3 FROM bg
        UNION ALL SELECT scene, k, t, labs, x1, x2, x3 FROM (SELECT s.scene, s.k + 1 AS k, c.t, list_append(s.labs, {{'l': c.l, 'a': c.a, 'b': c.b}}) AS labs, c.x1, c.x2, c.x3, row_number() OVER (PARTITION BY s.scene ORDER BY c.t) AS rn
            FROM sel s JOIN valid c ON s.scene = c.scene AND c.t > s.t AND c.t - s.t <= {TRIES} AND s.k < {COLORS - 1} AND {_FAR}) WHERE rn = 1)
    SELECT scene, k, t, floor(greatest(0, least(1, x1)) * 255 + 0.5e0)::INT AS red, floor(greatest(0, least(1, x2)) * 255 + 0.5e0)::INT AS green, floor(greatest(0, least(1, x3)) * 255 + 0.5e0)::INT AS blue FROM sel WHERE k >= 0)"""))
def scene_palettes(spark, sf_dir):
    """Four colours a scene, over 20 (CIE76) from each other and from the bottom shape's, by rejection: t is the draw that gave each."""
    ground = derive.shapes(spark, sf_dir).groupBy("scene").agg(F.min_by("fill", "z").alias("name"))
    ground = ground.join(F.broadcast(dims.palette(spark)), "name").withColumn("avoid", F.array(color.lab_struct(F.col("r"), F.col("g"), F.col("b"))))  # eleven colours
    keyed_ = ground.select("scene", F.concat(F.lit("palette|"), F.col("scene").cast("string")).alias("stream"), "avoid")
    found = sampling.palettes(keyed_, "stream", "avoid", n=COLORS, apart=APART, tries=TRIES)
    rows = found.select(F.substring_index("stream", "|", -1).cast("long").alias("scene"), F.posexplode("chosen").alias("k", "c"))
    return rows.select("scene", "k", "c.t", "c.red", "c.green", "c.blue")


_SIDES = ", ".join(f"({n}, {52**n}, {2 ** -(-(52**n - 1).bit_length() // 2)})" for n in range(dressing.SHORTEST, dressing.LONGEST + 1))


def _word_sql(want: str) -> str:
    """(key, i, word) of the rows (key, i) of ``want``: the network's rounds one by one, until a place is in range, then its letters."""
    length = f"{dressing.SHORTEST} + floor({keyed.sql_share(keyed.sql_digest('key', 'i'))} * {dressing.LONGEST - dressing.SHORTEST + 1})::INT"
    turned = keyed.sql_whole(keyed.sql_digest("key || '|' || len", "n % 4", "r"))
    return f"""(WITH RECURSIVE walk AS (SELECT key, i, len, size, side, i // side AS l, i % side AS r, 0 AS n FROM (SELECT *, {length} AS len FROM {want}) JOIN (VALUES {_SIDES}) d(dlen, size, side) ON dlen = len
        UNION ALL SELECT key, i, len, size, side, r, (l + {turned} % side) % side, n + 1 FROM walk WHERE NOT (n > 0 AND n % 4 = 0 AND l * side + r < size))
    SELECT key, i, list_aggregate(list_transform(range(len - 1, -1, -1), lambda j: '{dressing.LETTERS}'[(l * side + r) // (52 ** j)::BIGINT % 52 + 1]), 'string_agg', '') AS word
    FROM walk WHERE n > 0 AND n % 4 = 0 AND l * side + r < size)"""


def _level(h: str, k: int, wide: str, low: str) -> str:
    return f"floor(({keyed.sql_share(h, k)} * {wide} + {low}) * 255 + 0.5e0)::INT"


_TH, _TX = keyed.sql_digest("chart", "'theme'"), keyed.sql_digest("chart", "'text'")
_DARK = f"{keyed.sql_share(_TH, 3)} < 0.3e0"
_GROUND = ", ".join(_level(_TH, k, "0.35e0", f"CASE WHEN {_DARK} THEN 0 ELSE 0.6e0 END") for k in range(3))
_INK = ", ".join(_level(_TX, k, "0.3e0", f"CASE WHEN {_DARK} THEN 0.7e0 ELSE 0 END") for k in range(3))
_MORE = f"floor({keyed.sql_share(keyed.sql_digest('key', "'words'", 'i'))} * 3)"


@query(f"""SELECT chart, i, word AS label, concat_ws(' ', word, w1.w, w2.w) AS title, pow(10e0, floor({keyed.sql_share(keyed.sql_digest('chart', "'magnitude'"))} * 7) - 3) AS magnitude,
    printf('#%02X%02X%02X', {_GROUND}) AS ground, printf('#%02X%02X%02X', {_INK}) AS ink FROM (
    WITH b AS (SELECT c_nationkey AS chart, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
    k0 AS (SELECT chart::VARCHAR AS key, i FROM b), k1 AS (SELECT key || '|word 1' AS key, i FROM k0 WHERE {_MORE} >= 1), k2 AS (SELECT key || '|word 2' AS key, i FROM k0 WHERE {_MORE} >= 2),
    w0 AS {_word_sql('k0')}, w1 AS {_word_sql('k1')}, w2 AS {_word_sql('k2')}
    SELECT b.chart, b.i, w0.word, {{'w': w1.word}} AS w1, {{'w': w2.word}} AS w2 FROM b JOIN w0 ON w0.key = chart::VARCHAR AND w0.i = b.i LEFT JOIN w1 ON w1.key = chart || '|word 1' AND w1.i = b.i LEFT JOIN w2 ON w2.key = chart || '|word 2' AND w2.i = b.i)""")
def chart_dressing(spark, sf_dir):
    """A bar for every customer, a chart for every nation: labels and titles that don't repeat in a chart, its magnitude and colours."""
    c = derive.read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("chart"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long").alias("i"))
    key = F.col("chart").cast("string")
    ground, ink = dressing.theme(F.col("chart"))
    return rows.select("chart", "i", dressing.distinct_word(key, F.col("i")).alias("label"), dressing.title(key, F.col("i")).alias("title"), dressing.magnitude(F.col("chart")).alias("magnitude"), ground.alias("ground"), ink.alias("ink"))
