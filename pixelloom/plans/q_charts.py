"""Queries: edits of bars, heatmaps, series, networks and scatters; their functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..functions import color, text
from ..operators import graph, sequence
from ..registry import query
from . import derive
from .derive import SQL, with_sql

SQL["scatter"] = "scatter AS (SELECT c_nationkey AS chart, c_mktsegment AS class, c_custkey AS i, (c_custkey % 97)::DOUBLE AS x, round(c_acctbal / 100, 4) AS y FROM customer)"


def scatter(spark, sf_dir):
    return derive.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chart"), F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("i"), (F.col("c_custkey") % 97).cast("double").alias("x"), F.round(F.col("c_acctbal") / 100, 4).alias("y"))


# -- bars -------------------------------------------------------------------------------------------

@query(with_sql("bars", query="SELECT chart, ord, name, value FROM bars UNION ALL SELECT chart, count(*) AS ord, 'NEW' AS name, round(avg(value), 2) AS value FROM bars GROUP BY chart"))
def bar_add(spark, sf_dir):
    b = derive.bars(spark, sf_dir)
    return b.unionByName(b.groupBy("chart").agg(F.count(F.lit(1)).alias("ord"), F.lit("NEW").alias("name"), F.round(F.avg("value"), 2).alias("value")))


@query(with_sql("bars", query="SELECT chart, row_number() OVER (PARTITION BY chart ORDER BY value DESC, name) - 1 AS ord, name, value FROM bars"))
def bar_sort(spark, sf_dir):
    return derive.bars(spark, sf_dir).withColumn("ord", (F.row_number().over(Window.partitionBy("chart").orderBy(F.desc("value"), "name")) - 1).cast("long"))


@query(with_sql("bars", query="SELECT chart, ord, name, CASE WHEN ord = chart % 5 THEN NULL ELSE value END AS value FROM bars"))
def bar_blank(spark, sf_dir):
    return derive.bars(spark, sf_dir).withColumn("value", F.when(F.col("ord") != F.col("chart") % 5, F.col("value")))


@query(with_sql("bars", query="SELECT chart, ord, name, value, CASE WHEN ord = (chart + 1) % 5 THEN '#C31B37' ELSE '#' || lpad(upper(hex(ord * 4369)), 6, '0') END AS color FROM bars"))
def bar_recolor(spark, sf_dir):
    own = F.concat(F.lit("#"), F.lpad(F.hex(F.col("ord") * 4369), 6, "0"))
    return derive.bars(spark, sf_dir).withColumn("color", F.when(F.col("ord") == (F.col("chart") + 1) % 5, "#C31B37").otherwise(own))


@query(with_sql("bars", query="SELECT chart, coalesce(bool_and(d >= 0), true) AS is_ascending, coalesce(bool_and(d <= 0), true) AS is_descending FROM (SELECT chart, value - lag(value) OVER (PARTITION BY chart ORDER BY ord) AS d FROM bars) GROUP BY chart"))
def is_monotone(spark, sf_dir):
    return sequence.monotone(derive.bars(spark, sf_dir), "chart", "ord", "value")


@query(with_sql("bars", query="SELECT chart, round(min(g), 4) AS gap, round(max(value) - min(value), 4) AS spread, coalesce(min(g) >= (max(value) - min(value)) * 0.05e0, true) AS wide_enough FROM (SELECT chart, value, value - lag(value) OVER (PARTITION BY chart ORDER BY value) AS g FROM bars) GROUP BY chart"))
def min_gap_check(spark, sf_dir):
    return sequence.min_gap(derive.bars(spark, sf_dir), "chart", "value", 0.05).select("chart", F.round("gap", 4).alias("gap"), F.round("spread", 4).alias("spread"), "wide_enough")


# -- heatmap ----------------------------------------------------------------------------------------

@query(with_sql("grid", query="SELECT r, c, coalesce(v, CASE WHEN r * 9 + c = (SELECT min(r * 9 + c) FROM grid WHERE v IS NULL) THEN (SELECT round(avg(v), 4) FROM grid) END) AS v FROM grid"))
def heatmap_add_cell(spark, sf_dir):
    """The first hole gets the mean; the statistics are one row."""
    g = derive.grid(spark, sf_dir)
    s = g.agg(F.min(F.when(F.col("v").isNull(), F.col("r") * 9 + F.col("c"))).alias("hole"), F.round(F.avg("v"), 4).alias("m"))
    return g.crossJoin(F.broadcast(s)).select("r", "c", F.coalesce("v", F.when(F.col("r") * 9 + F.col("c") == F.col("hole"), F.col("m"))).alias("v"))


@query(with_sql("grid", query="SELECT a.r, a.c, b.v FROM grid a LEFT JOIN grid b ON a.r = b.r + 1 AND a.c = b.c + 2"))
def heatmap_shift(spark, sf_dir):
    g = derive.grid(spark, sf_dir)
    moved = g.select((F.col("r") + 1).alias("r"), (F.col("c") + 2).alias("c"), "v")
    return g.select("r", "c").join(moved, ["r", "c"], "left")


@query(with_sql("grid", query="SELECT r, c, CASE WHEN v > (SELECT quantile_cont(v, 0.6) FROM grid) THEN NULL ELSE v END AS v FROM grid"))
def heatmap_mask_threshold(spark, sf_dir):
    g = derive.grid(spark, sf_dir)
    s = g.agg(F.percentile("v", F.lit(0.6)).alias("q"))
    return g.crossJoin(F.broadcast(s)).select("r", "c", F.when(~(F.col("v") > F.col("q")), F.col("v")).alias("v"))


@query(with_sql("grid", query="SELECT q, CASE WHEN t = 0 THEN 0 ELSE round_even(t * pow(10e0, 2 - floor(log10(abs(t)))), 0) / pow(10e0, 2 - floor(log10(abs(t)))) END AS threshold FROM (SELECT 0.3e0 AS q, quantile_cont(v, 0.3) AS t FROM grid UNION ALL SELECT 0.7e0, quantile_cont(v, 0.7) FROM grid)"))
def quantile_threshold(spark, sf_dir):
    s = derive.grid(spark, sf_dir).agg(F.percentile("v", F.lit(0.3)).alias("a"), F.percentile("v", F.lit(0.7)).alias("b"))
    rows = s.select(F.explode(F.array(F.struct(F.lit(0.3).alias("q"), F.col("a").alias("t")), F.struct(F.lit(0.7).alias("q"), F.col("b").alias("t")))).alias("x"))
    return rows.select("x.q", text.round_sig(F.col("x.t")).alias("threshold"))


@query(with_sql("grid", query="SELECT r, c, v, round_even(255 + (30 - 255) * t, 0)::INT AS red, round_even(255 + (60 - 255) * t, 0)::INT AS green, round_even(255 + (200 - 255) * t, 0)::INT AS blue FROM (SELECT *, (v - min(v) OVER ()) / greatest(max(v) OVER () - min(v) OVER (), 1e-9) AS t FROM grid)"))
def colormap_lerp(spark, sf_dir):
    g = derive.grid(spark, sf_dir)
    s = g.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    g = g.crossJoin(F.broadcast(s)).withColumn("t", t)
    return g.select("r", "c", "v", *(color.lerp(F.lit(255.0), F.lit(float(b)), F.col("t")).alias(n) for n, b in (("red", 30), ("green", 60), ("blue", 200))))


# -- series -----------------------------------------------------------------------------------------

@query(with_sql("series", query="SELECT user_id, i, round(100 + sum(y - 100) OVER (PARTITION BY user_id ORDER BY i), 4) AS walk FROM series"))
def series_cumsum(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return derive.series(spark, sf_dir).select("user_id", "i", F.round(F.sum(F.col("y") - 100).over(w) + 100, 4).alias("walk"))


@query(with_sql("series", query="SELECT user_id, i, round((y - min(y) OVER (PARTITION BY user_id)) / greatest(max(y) OVER (PARTITION BY user_id) - min(y) OVER (PARTITION BY user_id), 1e-9) * 80 + 10, 6) AS y FROM series"))
def series_normalize(spark, sf_dir):
    s = derive.series(spark, sf_dir)
    return s.select("user_id", "i", F.round(sequence.rescaled(s, "user_id", "y", 10.0, 90.0), 6).alias("y"))


@query(with_sql("series", query="SELECT user_id, i, y FROM series WHERE i BETWEEN 5 AND 12"))
def series_interval(spark, sf_dir):
    return derive.series(spark, sf_dir).where(F.col("i").between(5, 12)).select("user_id", "i", "y")


@query(with_sql("series", query="SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS j, i, y FROM series WHERE event_type <> 'error'"))
def series_bridge_gaps(spark, sf_dir):
    s = derive.series(spark, sf_dir).where("event_type <> 'error'")
    return s.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("i")) - 1).cast("long").alias("j"), "i", "y")


@query(with_sql("series", query="SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM series WHERE event_type <> 'click') GROUP BY user_id, g"))
def contiguous_runs(spark, sf_dir):
    return sequence.runs_of(derive.series(spark, sf_dir).where("event_type <> 'click'"), "user_id", "i")


@query(with_sql("series", query="""
    , s AS (SELECT user_id, i::DOUBLE AS x, y, lead(i::DOUBLE) OVER w AS nx, lead(y) OVER w AS ny FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    p AS (SELECT user_id, x, y, 0 AS b FROM s WHERE y <= 150 UNION ALL SELECT user_id, x + (150.0e0 - y) / (ny - y) * (nx - x), 150.0e0, CASE WHEN y <= 150 THEN 0 ELSE 1 END FROM s WHERE ny IS NOT NULL AND (y <= 150) <> (ny <= 150)),
    k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY x, b DESC ROWS UNBOUNDED PRECEDING) AS piece FROM p)
    SELECT user_id, (piece - min(piece) OVER (PARTITION BY user_id))::BIGINT AS piece, round(x, 6) AS x, round(y, 6) AS y FROM k"""))
def series_clip_threshold(spark, sf_dir):
    c = sequence.clipped(derive.series(spark, sf_dir), "user_id", "i", "y", 150.0)
    return c.select("user_id", "piece", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(with_sql("series", query="SELECT DISTINCT a.user_id FROM series a JOIN series b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(a.i - b.i) <= 1 WHERE a.event_type = 'error'"))
def intersect_buffer(spark, sf_dir):
    """Users whose error positions touch the one-step surroundings of a purchase."""
    s = derive.series(spark, sf_dir)
    near = s.where("event_type = 'purchase'").select("user_id", F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i"))
    return s.where("event_type = 'error'").select("user_id", "i").join(near, ["user_id", "i"], "left_semi").select("user_id").distinct()


@query(with_sql("series", query="SELECT user_id, i FROM (SELECT user_id, unnest(range(0, (SELECT max(i) + 1 FROM series))) AS i FROM (SELECT DISTINCT user_id FROM series)) EXCEPT SELECT user_id, i FROM series WHERE event_type <> 'view'"))
def except_candidates(spark, sf_dir):
    """All positions less those that are kept."""
    s = derive.series(spark, sf_dir)
    top = s.agg(F.max("i").alias("m"))
    every = s.select("user_id").distinct().crossJoin(F.broadcast(top)).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("i"))
    return every.subtract(s.where("event_type <> 'view'").select("user_id", "i"))


# -- networks ----------------------------------------------------------------------------------------

@query(with_sql("edges", query="SELECT node, count(*) AS degree, string_agg(lpad(n::VARCHAR, 2, '0'), ',' ORDER BY n) AS neighbours FROM (SELECT i AS node, j AS n FROM edges UNION ALL SELECT j, i FROM edges) GROUP BY node"))
def graph_neighbors(spark, sf_dir):
    n = graph.neighbours(derive.edges(spark, sf_dir))
    return n.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.sort_array(F.collect_list(text.zero_pad(F.col("neighbour"), 2))), ",").alias("neighbours"))


@query(with_sql("edges", query="SELECT i, j FROM edges WHERE i % 5 <> 2 AND j % 5 <> 2"))
def graph_remove_node(spark, sf_dir):
    return graph.without(derive.edges(spark, sf_dir), F.col("node") % 5 == 2)


@query(with_sql("edges", query="SELECT least(a, b) AS i, greatest(a, b) AS j FROM (SELECT CASE i WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE i END AS a, CASE j WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE j END AS b FROM edges)"))
def graph_swap_nodes(spark, sf_dir):
    return graph.swapped(derive.edges(spark, sf_dir), 3, 7)


@query("SELECT n_nationkey AS node, n_name AS label, CASE WHEN n_nationkey = 4 THEN 'gold' ELSE " + dims.sql_list(dims.PALETTE) + "[n_regionkey % 11 + 1] END AS color FROM nation")
def graph_recolor(spark, sf_dir):
    n = derive.read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") == 4, "gold").otherwise(dims.pick(dims.PALETTE, F.col("n_regionkey") % 11)).alias("color"))


# -- scatters ----------------------------------------------------------------------------------------

@query(with_sql("scatter", query="SELECT chart, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM scatter GROUP BY chart"))
def linear_fit(spark, sf_dir):
    return scatter(spark, sf_dir).groupBy("chart").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query(with_sql("scatter", query="SELECT chart, arg_max(i, (round(abs(y - s * x - k), 6), -i)) AS outlier, max(round(abs(y - s * x - k), 6)) AS residual FROM scatter JOIN (SELECT chart, regr_slope(y, x) AS s, regr_intercept(y, x) AS k FROM scatter GROUP BY chart) f USING (chart) GROUP BY chart"))
def argmax_residual(spark, sf_dir):
    s = scatter(spark, sf_dir)
    fit = s.groupBy("chart").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("k"))
    r = s.join(fit, "chart").withColumn("r", F.round(F.abs(F.col("y") - F.col("s") * F.col("x") - F.col("k")), 6))
    return r.groupBy("chart").agg(F.max_by("i", F.struct("r", -F.col("i"))).alias("outlier"), F.max("r").alias("residual"))


@query(with_sql("scatter", query="SELECT chart, class, i, y AS x, x AS y FROM scatter"))
def swap_axes(spark, sf_dir):
    return scatter(spark, sf_dir).select("chart", "class", "i", F.col("y").alias("x"), F.col("x").alias("y"))


@query(with_sql("scatter", query="SELECT chart, class, count(*) AS n, CASE WHEN class = 'BUILDING' THEN '#0FE1DF' ELSE '#808080' END AS color FROM scatter GROUP BY ALL"))
def recolor_class(spark, sf_dir):
    return scatter(spark, sf_dir).groupBy("chart", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("color", F.when(F.col("class") == "BUILDING", "#0FE1DF").otherwise("#808080"))


# -- functions ---------------------------------------------------------------------------------------

_pl = color.sql_lab("r", "g", "b")


@query(with_sql("shapes", query="SELECT x.scene, x.z AS za, y.z AS zb, round(sqrt((x.l - y.l) * (x.l - y.l) + (x.m - y.m) * (x.m - y.m) + (x.n - y.n) * (x.n - y.n)), 6) AS de FROM (SELECT scene, z, " + ", ".join(f"{e} AS {n}" for n, e in zip("lmn", _pl)) + " FROM shapes JOIN " + dims.sql_palette() + " ON name = fill) x JOIN (SELECT scene, z, " + ", ".join(f"{e} AS {n}" for n, e in zip("lmn", _pl)) + " FROM shapes JOIN " + dims.sql_palette() + " ON name = fill) y ON x.scene = y.scene AND x.z < y.z"))
def palette_distinctness(spark, sf_dir):
    """How far apart the colours of each scene's ten shapes are, pair by pair."""
    p = dims.palette(spark).select(F.col("name").alias("fill"), color.lab_struct(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    s = derive.shapes(spark, sf_dir).join(F.broadcast(p), "fill").select("scene", "z", "lab")  # eleven colours
    a, b = s.select("scene", F.col("z").alias("za"), F.col("lab").alias("la")), s.select("scene", F.col("z").alias("zb"), F.col("lab").alias("lb"))
    return a.join(b, "scene").where("za < zb").select("scene", "za", "zb", F.round(color.delta_e(F.col("la"), F.col("lb")), 6).alias("de"))


@query("SELECT event_id, CASE WHEN value = 0 THEN 0 ELSE round_even(value * pow(10e0, 2 - floor(log10(abs(value)))), 0) / pow(10e0, 2 - floor(log10(abs(value)))) END AS v FROM events")
def round_sig3(spark, sf_dir):
    return derive.read(spark, sf_dir, "events").select("event_id", text.round_sig(F.col("value")).alias("v"))


@query("""SELECT n_regionkey, part, CASE WHEN n = 1 THEN l[1] WHEN n = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:n-1], ', ') || ', and ' || l[n] END AS names FROM
    (SELECT n_regionkey, n_nationkey % 3 AS part, list(n_name ORDER BY n_name) AS l, count(*) AS n FROM nation GROUP BY ALL)""")
def oxford_join(spark, sf_dir):
    n = derive.read(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 3).alias("part")).agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return n.select("n_regionkey", "part", text.oxford(F.col("l")).alias("names"))


@query("SELECT p_partkey, printf('#%02X%02X%02X', p_partkey % 256, p_partkey * 3 % 256, p_partkey * 7 % 256) AS hex FROM part")
def hex_color(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.read(spark, sf_dir, "part").select("p_partkey", color.hex_color(k % 256, k * 3 % 256, k * 7 % 256).alias("hex"))


@query("SELECT p_partkey, round((p_partkey % 256) * 0.299e0 + (p_partkey * 3 % 256) * 0.587e0 + (p_partkey * 7 % 256) * 0.114e0, 6) AS lum, CASE WHEN (p_partkey % 256) * 0.299e0 + (p_partkey * 3 % 256) * 0.587e0 + (p_partkey * 7 % 256) * 0.114e0 > 128 THEN 'black' ELSE 'white' END AS contrast FROM part")
def luminance(spark, sf_dir):
    k = F.col("p_partkey")
    lum = color.luminance(k % 256, k * 3 % 256, k * 7 % 256)
    return derive.read(spark, sf_dir, "part").select("p_partkey", F.round(lum, 6).alias("lum"), F.when(lum > 128, "black").otherwise("white").alias("contrast"))


@query("SELECT p_partkey, round_even((p_partkey % 256) + ((p_partkey * 7 % 256) - (p_partkey % 256)) * (p_size / 50.0e0), 0)::INT AS v FROM part")
def lerp_color(spark, sf_dir):
    k = F.col("p_partkey")
    return derive.read(spark, sf_dir, "part").select("p_partkey", color.lerp((k % 256).cast("double"), (k * 7 % 256).cast("double"), F.col("p_size") / 50.0).alias("v"))


@query("SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM part")
def ordinal_label(spark, sf_dir):
    return derive.read(spark, sf_dir, "part").select("p_partkey", text.ordinal(F.col("p_partkey")).alias("label"))
