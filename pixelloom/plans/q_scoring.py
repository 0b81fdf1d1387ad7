"""Queries: scoring, rollups, bootstrap, leaderboard and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dims
from ..functions import color
from ..operators import bootstrap, rollup, scoring
from ..registry import query
from ..sources import shared
from . import derive
from .derive import SQL, with_sql

M = scoring.METRICS
KEYS = ["model", "sid"]

_labs = {k: color.sql_lab(f"{k}r", f"{k}g", f"{k}b") for k in "iap"}
SQL["lab"] = "lab AS (SELECT *, " + ", ".join(f"{e} AS {k}_{n}" for k, v in _labs.items() for n, e in zip("lmn", v)) + " FROM px)"
SQL["de"] = """de AS (SELECT *, ir <> ar OR ig <> ag OR ib <> ab AS edit, sqrt((p_l - a_l) * (p_l - a_l) + (p_m - a_m) * (p_m - a_m) + (p_n - a_n) * (p_n - a_n)) AS de,
    sqrt((p_l - i_l) * (p_l - i_l) + (p_m - i_m) * (p_m - i_m) + (p_n - i_n) * (p_n - i_n)) AS de_in FROM lab)"""
SQL["cnt"] = """cnt AS (SELECT model, sid, t, count_if(edit) AS ep, count_if(NOT edit) AS pp, count_if(edit AND de <= t) AS ec, count_if(NOT edit AND de <= t) AS pc, count_if(de_in > t) AS ch
    FROM de, range(0, 11) AS th(t) GROUP BY ALL)"""
SQL["sc"] = """sc AS (SELECT model, sid, t, ep, pp, ec, pc, CASE WHEN ep = 0 THEN 1 ELSE ec / ep END AS ea, CASE WHEN pp = 0 THEN 1 ELSE pc / pp END AS pa,
    CASE WHEN ep + pp - pc = 0 THEN 1 ELSE ec / (ep + pp - pc) END AS iou, ch FROM cnt)"""
SQL["ps"] = """ps AS (SELECT model, category, task, mode, visual_condition, p.sid, has_output, correct_output_size, t, CASE WHEN has_output THEN ea ELSE 0 END AS ea, CASE WHEN has_output THEN pa ELSE 0 END AS pa,
    CASE WHEN has_output THEN iou WHEN ep + pp = 0 THEN 1 ELSE 0 END AS iou, CASE WHEN has_output THEN ch ELSE 0 END AS ch, CASE WHEN has_output THEN ec ELSE 0 END AS ec, CASE WHEN has_output THEN pc ELSE 0 END AS pc, ep, pp
    FROM sc JOIN prob p ON sc.sid = p.sid)"""
SQL["pl"] = """pl AS (SELECT model, category, task, mode, visual_condition, sid, has_output, correct_output_size, t::VARCHAR AS block, ea AS edit_accuracy, pa AS preservation_accuracy, iou, ch::DOUBLE AS changed_pixels FROM ps
    UNION ALL SELECT model, category, task, mode, visual_condition, sid, has_output, correct_output_size, 'mean', avg(ea), avg(pa), avg(iou), avg(ch) FROM ps GROUP BY ALL)"""
SQL["cpl"] = """cps AS (SELECT model, task, p.sid, has_output, correct_output_size, t, CASE WHEN has_output THEN ea ELSE 0 END AS ea, CASE WHEN has_output THEN pa ELSE 0 END AS pa,
    CASE WHEN has_output THEN iou WHEN ep + pp = 0 THEN 1 ELSE 0 END AS iou, CASE WHEN has_output THEN ch ELSE 0 END AS ch FROM sc JOIN cprob p ON sc.sid = p.sid),
    cpl0 AS (SELECT model, task, sid, has_output, correct_output_size, t::VARCHAR AS block, ea AS edit_accuracy, pa AS preservation_accuracy, iou, ch::DOUBLE AS changed_pixels FROM cps
    UNION ALL SELECT model, task, sid, has_output, correct_output_size, 'mean', avg(ea), avg(pa), avg(iou), avg(ch) FROM cps GROUP BY ALL),
    cpl AS (SELECT c.chart, substr(cpl0.task, length(c.chart) + 2) AS label, cpl0.* FROM cpl0 JOIN (SELECT DISTINCT chart FROM """ + dims.sql_charts() + """) c ON starts_with(cpl0.task, c.chart || '_'))"""
BASE = ("px", "lab", "de", "cnt", "sc")
LONG = (*BASE, "prob", "ps", "pl")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(derive.pixels(spark, sf_dir), KEYS)


def problem_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined to their problems; without output the blocks are zero."""
    s = scored(spark, sf_dir).join(derive.problems(spark, sf_dir), "sid")
    return s.withColumn("blocks", F.when(F.col("has_output"), F.col("blocks")).otherwise(scoring.zero_blocks(F.col("edit_pixels"), F.col("preservation_pixels"))))


PROB = ["model", "category", "task", "mode", "visual_condition", "sid", "has_output", "correct_output_size"]


def long(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Scores of problems by block; ``once``: what several levels read is scored once and stored, a row a problem."""
    s = problem_stats(spark, sf_dir)
    return scoring.long_form(shared.stored(s, "scores") if once else s, PROB)


def chart_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).join(derive.chart_problems(spark, sf_dir), "sid")
    s = s.withColumn("blocks", F.when(F.col("has_output"), F.col("blocks")).otherwise(scoring.zero_blocks(F.col("edit_pixels"), F.col("preservation_pixels"))))
    chart = longest_prefix(F.col("task"), tuple(dims.CHARTS))
    s = shared.stored(s.withColumn("chart", chart).withColumn("task", F.col("task").substr(F.length("chart") + 2, F.lit(1000))), "chart-scores")
    return scoring.long_form(s, ["model", "chart", "task", "sid", "has_output", "correct_output_size"])


def longest_prefix(name, known: tuple[str, ...]):
    """The longest known name that ``name`` is or begins with (before ``_``); else ``name``."""
    hit = None
    for k in sorted(known, key=lambda k: (-len(k), k)):
        cond = (name == k) | name.startswith(f"{k}_")
        hit = F.when(cond, k) if hit is None else hit.when(cond, k)
    return hit.otherwise(name)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# -- pixels ------------------------------------------------------------------------------------------

@query(with_sql("px", "lab", query="SELECT DISTINCT ar, ag, ab, round(a_l, 6) AS l, round(a_m, 6) AS a, round(a_n, 6) AS b FROM lab"))
def cie_lab_projection(spark, sf_dir):
    px = derive.pixels(spark, sf_dir).select("ar", "ag", "ab").distinct()
    l, a, b = color.lab(F.col("ar"), F.col("ag"), F.col("ab"))
    return px.select("ar", "ag", "ab", F.round(l, 6).alias("l"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query(with_sql("px", "lab", "de", query="SELECT model, sid, round(sum(de), 3) AS sum_de, round(max(de), 6) AS max_de, round(sum(de_in), 3) AS sum_de_in FROM de GROUP BY ALL"))
def delta_e76(spark, sf_dir):
    d = scoring.with_distances(derive.pixels(spark, sf_dir))
    return d.groupBy(*KEYS).agg(F.round(F.sum("de"), 3).alias("sum_de"), F.round(F.max("de"), 6).alias("max_de"), F.round(F.sum("de_in"), 3).alias("sum_de_in"))


@query(with_sql("px", query="SELECT model, sid, count_if(ir <> ar OR ig <> ag OR ib <> ab) AS edit_pixels, count_if(ir = ar AND ig = ag AND ib = ab) AS preservation_pixels FROM px GROUP BY ALL"))
def edit_mask_counts(spark, sf_dir):
    return derive.pixels(spark, sf_dir).groupBy(*KEYS).agg(F.count_if(scoring.changed_mask()).alias("edit_pixels"), F.count_if(~scoring.changed_mask()).alias("preservation_pixels"))


@query(with_sql(*BASE, query="SELECT model, sid, t::INT AS t, ep AS edit_pixels, pp AS preservation_pixels, ec AS edit_correct_pixels, pc AS preservation_correct_pixels, round(ea, 9) AS edit_accuracy, round(pa, 9) AS preservation_accuracy, round(iou, 9) AS iou, ch AS changed_pixels FROM sc"))
def score_thresholds(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(s.select(*KEYS, "edit_pixels", "preservation_pixels", F.explode("blocks").alias("x")).select(*KEYS, "x.t", "edit_pixels", "preservation_pixels", *(f"x.{f}" for f in scoring.BLOCK_FIELDS)))


@query(with_sql(*BASE, query="SELECT model, sid, round(ea, 9) AS edit_accuracy, round(pa, 9) AS preservation_accuracy, round(iou, 9) AS iou FROM sc WHERE t = 2"))
def accuracy_iou(spark, sf_dir):
    b = F.element_at("blocks", 3)
    return scored(spark, sf_dir).select(*KEYS, *(F.round(b[m], 9).alias(m) for m in M[:3]))


@query(with_sql(*BASE, query="SELECT model, sid, t::INT AS t, ch AS changed_pixels FROM sc"))
def changed_pixels(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, F.explode("blocks").alias("x")).select(*KEYS, "x.t", "x.changed_pixels")


@query(with_sql(*BASE, query="SELECT model, sid, round(avg(ec), 9) AS edit_correct_pixels, round(avg(pc), 9) AS preservation_correct_pixels, round(avg(ea), 9) AS edit_accuracy, round(avg(pa), 9) AS preservation_accuracy, round(avg(iou), 9) AS iou, round(avg(ch), 9) AS changed_pixels FROM sc GROUP BY ALL"))
def threshold_mean(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, *(F.round(scoring.mean_of_blocks(F.col("blocks"), f), 9).alias(f) for f in scoring.BLOCK_FIELDS))


@query(with_sql("px", "lab", "de", query="""SELECT model, t::INT AS t, CASE WHEN edit THEN CASE WHEN de <= t THEN 'green' ELSE 'red' END ELSE CASE WHEN de <= t THEN 'blue' ELSE 'orange' END END AS diff_class,
    count(*) AS n FROM de, (VALUES (0), (2), (5), (10)) AS v(t) GROUP BY ALL"""))
def diff_class_counts(spark, sf_dir):
    d = scoring.with_distances(derive.pixels(spark, sf_dir))
    sums = [F.count_if(scoring.diff_class(F.col("edit"), F.col("de"), t) == k).alias(f"{k}_{t}") for t in dims.DIFF_THRESHOLDS for k in ("green", "red", "blue", "orange")]
    g = d.groupBy("model").agg(*sums)
    rows = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("diff_class"), F.col(f"{k}_{t}").alias("n")) for t in dims.DIFF_THRESHOLDS for k in ("green", "red", "blue", "orange")))
    return g.select("model", F.explode(rows).alias("x")).select("model", "x.*").where("n > 0")


@query(with_sql("px", query="SELECT model, sid, count_if(d > 10) AS n_green, count_if(d <= 10) AS n_dim, sum(CASE WHEN d <= 10 THEN pr // 4 ELSE 0 END)::BIGINT AS dim_red FROM (SELECT *, abs(pr - ar) + abs(pg - ag) + abs(pb - ab) AS d FROM px) GROUP BY ALL"))
def l1_diff_mask(spark, sf_dir):
    d = sum((F.abs(F.col(f"p{c}") - F.col(f"a{c}")) for c in "gb"), F.abs(F.col("pr") - F.col("ar")))
    return derive.pixels(spark, sf_dir).withColumn("d", d).groupBy(*KEYS).agg(F.count_if(F.col("d") > 10).alias("n_green"), F.count_if(F.col("d") <= 10).alias("n_dim"), F.sum(F.when(F.col("d") <= 10, F.shiftright("pr", 2)).otherwise(0)).cast("long").alias("dim_red"))


@query("""SELECT p_partkey, w_out, h_out, w_ans, h_ans, nw AS scaled_w, nh AS scaled_h, (nw - w_ans) // 2 AS crop_x, (nh - h_ans) // 2 AS crop_y FROM (
    SELECT *, CASE WHEN w_out = w_ans AND h_out = h_ans THEN w_ans ELSE ceil(w_out * s)::BIGINT END AS nw, CASE WHEN w_out = w_ans AND h_out = h_ans THEN h_ans ELSE ceil(h_out * s)::BIGINT END AS nh FROM (
    SELECT p_partkey, 32 + p_partkey % 64 AS w_out, 32 + p_partkey * 3 % 64 AS h_out, 32 + p_partkey % 5 * 16 AS w_ans, 32 + p_partkey % 3 * 16 AS h_ans,
        greatest((32 + p_partkey % 5 * 16) / (32 + p_partkey % 64), (32 + p_partkey % 3 * 16) / (32 + p_partkey * 3 % 64)) AS s FROM part))""")
def normalize_geometry(spark, sf_dir):
    k = F.col("p_partkey")
    p = derive.read(spark, sf_dir, "part").select("p_partkey", (32 + k % 64).alias("w_out"), (32 + k * 3 % 64).alias("h_out"), (32 + k % 5 * 16).alias("w_ans"), (32 + k % 3 * 16).alias("h_ans"))
    g = scoring.fit_geometry(*(F.col(c) for c in ("w_out", "h_out", "w_ans", "h_ans")))
    return p.select("*", *(v.alias(n) for n, v in g.items()))


@query(with_sql(*BASE, "prob", "ps", query="SELECT model, sid, has_output, t::INT AS t, ec AS edit_correct_pixels, round(pa, 9) AS preservation_accuracy, round(iou, 9) AS iou FROM ps WHERE NOT has_output"))
def missing_output_zero(spark, sf_dir):
    s = problem_stats(spark, sf_dir).where("NOT has_output").select(*KEYS, "has_output", F.explode("blocks").alias("x"))
    return s.select(*KEYS, "has_output", "x.t", "x.edit_correct_pixels", F.round("x.preservation_accuracy", 9).alias("preservation_accuracy"), F.round("x.iou", 9).alias("iou"))


@query(with_sql("prob", query="SELECT task, count_if(correct_output_size) AS n_right, count_if(NOT correct_output_size) AS n_wrong, count_if(correct_output_size IS NULL) AS n_unknown FROM prob GROUP BY ALL"))
def size_match_tristate(spark, sf_dir):
    c = F.col("correct_output_size")
    return derive.problems(spark, sf_dir).groupBy("task").agg(F.count_if(c).alias("n_right"), F.count_if(~c).alias("n_wrong"), F.count_if(c.isNull()).alias("n_unknown"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '#' || lpad(upper(hex(event_id % 256)), 6, '0') ELSE coalesce(event_type, '') END AS bg_color,
    coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE event_type END, ''), 'default') AS mode, coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, '') AS visual_condition FROM events""")
def metadata_coalesce(spark, sf_dir):
    k, t = F.col("event_id"), F.col("event_type")
    own = F.when(k % 4 == 0, F.concat(F.lit("#"), F.lpad(F.hex(k % 256), 6, "0")))
    colors = F.coalesce(F.when(own.isNotNull(), F.array(own)), F.array(t))
    mode = F.when(k % 3 == 0, "").when(k % 3 == 2, t)
    return derive.read(spark, sf_dir, "events").select(
        "event_id", F.element_at(colors, 1).alias("bg_color"), F.coalesce(F.nullif(mode, F.lit("")), F.lit("default")).alias("mode"), F.coalesce(F.when(k % 5 != 0, t), F.lit("")).alias("visual_condition")
    )


@query("""WITH c AS (SELECT c_custkey, c_chart || '_' || c_mktsegment AS name FROM (SELECT *, ['bar', 'bar_chart', 'heatmap', 'line', 'line_chart', 'other'][c_custkey % 6 + 1] AS c_chart FROM customer)),
    m AS (SELECT c_custkey, name, max_by(k, length(k)) AS k FROM c LEFT JOIN (VALUES ('bar'), ('bar_chart'), ('heatmap'), ('line'), ('line_chart')) v(k) ON name = k OR starts_with(name, k || '_') GROUP BY ALL)
    SELECT c_custkey, name, coalesce(k, name) AS task, CASE WHEN k IS NULL THEN name ELSE substr(name, length(k) + 2) END AS label FROM m""")
def longest_prefix_task(spark, sf_dir):
    known = ("bar", "bar_chart", "heatmap", "line", "line_chart")
    c = derive.read(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.concat_ws("_", dims.pick((*known, "other"), F.col("c_custkey") % 6), F.col("c_mktsegment")).alias("name"))
    c = c.withColumn("task", longest_prefix(F.col("name"), known))
    return c.withColumn("label", F.when(F.col("task") == F.col("name"), F.col("name")).otherwise(F.col("name").substr(F.length("task") + 2, F.lit(1000))))


@query(with_sql(*BASE, "prob", "ps", query="SELECT model, sid, " + ", ".join(f"max(CASE WHEN t = {t} THEN round(CASE WHEN ep + pp = 0 THEN 0 ELSE (ec + pc) / (ep + pp) END, 9) END) AS prop_le_{t}_all" for t in (0, 2, 5, 10)) + " FROM ps GROUP BY ALL"))
def flatten_problem_stats(spark, sf_dir):
    total = F.col("edit_pixels") + F.col("preservation_pixels")
    prop = lambda t: F.coalesce((F.element_at("blocks", t + 1)["edit_correct_pixels"] + F.element_at("blocks", t + 1)["preservation_correct_pixels"]) / F.nullif(total, F.lit(0)), F.lit(0.0))
    return problem_stats(spark, sf_dir).select(*KEYS, *(F.round(prop(t), 9).alias(f"prop_le_{t}_all") for t in dims.DIFF_THRESHOLDS))


# -- rollups -----------------------------------------------------------------------------------------

def _stats(of: str) -> str:
    return ", ".join(f"round(avg({of}{m}), 9) AS mean_{m}, round(stddev_pop({of}{m}), 9) AS std_{m}" for m in M)


_COUNTS = "count(*) AS n_problems, count_if(coalesce(has_output, true)) AS n_with_output, count_if(coalesce(correct_output_size, false)) AS n_correct_output_size"
_SUMS = "count(*) AS n_tasks, sum(n_problems)::BIGINT AS n_problems, sum(n_with_output)::BIGINT AS n_with_output, sum(n_correct_output_size)::BIGINT AS n_correct_output_size"
_RAW = ", ".join(f"avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}" for m in M)
_MAC = ", ".join(f"avg(mean_{m}) AS mean_{m}, stddev_pop(mean_{m}) AS std_{m}" for m in M)
SQL["r_task"] = f"r_task AS (SELECT model, category, task, block, {_COUNTS}, {_RAW} FROM pl GROUP BY ALL)"
SQL["r_mode"] = f"r_mode AS (SELECT model, category, task, mode, block, {_COUNTS}, {_RAW} FROM pl WHERE (model, task) IN (SELECT (model, task) FROM pl GROUP BY model, task HAVING count(DISTINCT mode) > 1) GROUP BY ALL)"
SQL["r_cat"] = f"r_cat AS (SELECT model, category, block, {_SUMS}, {_MAC} FROM r_task WHERE category IS NOT NULL GROUP BY ALL)"
SQL["r_vc"] = f"r_vc0 AS (SELECT model, visual_condition, task, block, {_COUNTS}, {_RAW} FROM pl WHERE visual_condition <> '' AND category IS NOT NULL GROUP BY ALL), r_vc AS (SELECT model, visual_condition, block, {_SUMS}, {_MAC} FROM r_vc0 GROUP BY ALL)"
SQL["r_bench"] = f"r_bench AS (SELECT model, block, {_SUMS}, {_MAC} FROM r_cat GROUP BY ALL)"
_R = ", ".join(f"round({s}, 9) AS {s}" for s in rollup.STATS)
_C = ", ".join(rollup.COUNTS)


@query(with_sql(*LONG, "r_task", query=f"SELECT model, category, task, block, {_C}, {_R} FROM r_task"))
def rollup_task(spark, sf_dir):
    return rounded(rollup.micro(long(spark, sf_dir), ["model", "category", "task"]))


@query(with_sql(*LONG, "r_mode", query=f"SELECT model, category, task, mode, block, {_C}, {_R} FROM r_mode"))
def rollup_mode(spark, sf_dir):
    return rounded(rollup.mode_rows(long(spark, sf_dir, once=True)))


@query(with_sql(*LONG, query="SELECT model, task, count(DISTINCT mode) AS n_modes FROM pl GROUP BY ALL HAVING count(DISTINCT mode) > 1"))
def mode_rows_having(spark, sf_dir):
    return long(spark, sf_dir).select("model", "task", "mode").distinct().groupBy("model", "task").agg(F.count(F.lit(1)).alias("n_modes")).where("n_modes > 1")


@query(with_sql(*LONG, "r_task", "r_cat", query=f"SELECT model, category, block, n_tasks, {_C}, {_R} FROM r_cat"))
def rollup_category(spark, sf_dir):
    return rounded(rollup.macro(rollup.micro(long(spark, sf_dir), ["model", "category", "task"]), ["model", "category"]))


@query(with_sql(*LONG, "r_vc", query=f"SELECT model, visual_condition, block, n_tasks, {_C}, {_R} FROM r_vc"))
def rollup_visual_condition(spark, sf_dir):
    return rounded(rollup.macro(rollup.micro(long(spark, sf_dir), ["model", "visual_condition", "task"]), ["model", "visual_condition"]))


@query(with_sql(*LONG, "r_task", "r_cat", "r_bench", query=f"SELECT model, block, n_tasks, {_C}, {_R} FROM r_bench"))
def rollup_benchmark(spark, sf_dir):
    task = rollup.micro(long(spark, sf_dir), ["model", "category", "task"])
    return rounded(rollup.macro(rollup.macro(task, ["model", "category"]).drop("n_tasks"), ["model"]))


def _level(name: str, rel: str, have: dict[str, str]) -> str:
    cols = ", ".join(f"{have.get(c, 'NULL')} AS {c}" for c in ("category", "task", "mode", "visual_condition", "n_tasks"))
    return f"SELECT '{name}' AS level, model, {cols}, block, {_C}, {_R} FROM {rel}"


_ALL = " UNION ALL ".join([
    _level("mode", "r_mode", {"category": "category", "task": "task", "mode": "mode", "n_tasks": "NULL::BIGINT"}), _level("task", "r_task", {"category": "category", "task": "task"}),
    _level("category", "r_cat", {"category": "category", "n_tasks": "n_tasks"}), _level("visual_condition", "r_vc", {"visual_condition": "visual_condition", "n_tasks": "n_tasks"}), _level("benchmark", "r_bench", {"n_tasks": "n_tasks"}),
])
_LEVELS = (*LONG, "r_task", "r_mode", "r_cat", "r_vc", "r_bench")


@query(with_sql(*_LEVELS, query=_ALL))
def rollup_all_levels(spark, sf_dir):
    out = rounded(rollup.all_levels(long(spark, sf_dir, once=True)))
    return out.select("level", "model", "category", "task", "mode", "visual_condition", "n_tasks", "block", *rollup.COUNTS, *rollup.STATS)


@query(with_sql(*_LEVELS, query=f"""SELECT level, model, category, task, mode, visual_condition, row_number() OVER (ORDER BY model, list_position(['mode', 'task', 'category', 'visual_condition', 'benchmark'], level), category, task, mode, visual_condition) AS ord
    FROM ({_ALL}) WHERE block = 'mean'"""))
def agg_rows_ordered(spark, sf_dir):
    rows = rollup.all_levels(long(spark, sf_dir, once=True)).where("block = 'mean'")
    # DuckDB puts nulls last; one row per level and group, so the window is over the report, not the data.
    order = Window.orderBy("model", rollup.level_ord(), *(F.col(c).asc_nulls_last() for c in ("category", "task", "mode", "visual_condition")))
    return rows.select("level", "model", "category", "task", "mode", "visual_condition", F.row_number().over(order).cast("long").alias("ord"))


@query(with_sql(*BASE, "cprob", "cpl", query=f"""SELECT 'task' AS level, model, chart AS category, label AS task, NULL::BIGINT AS n_tasks, block, {_COUNTS}, {_stats('')} FROM cpl GROUP BY model, chart, label, block
    UNION ALL SELECT 'category', model, chart, NULL, count(*), block, sum(a)::BIGINT, sum(b)::BIGINT, sum(c)::BIGINT, {_stats('m_')} FROM (SELECT model, chart, label, block, count(*) AS a, count_if(has_output) AS b, count_if(correct_output_size) AS c, {', '.join(f'avg({m}) AS m_{m}' for m in M)} FROM cpl GROUP BY ALL) GROUP BY model, chart, block
    UNION ALL SELECT 'benchmark', model, NULL, NULL, count(*), block, sum(a)::BIGINT, sum(b)::BIGINT, sum(c)::BIGINT, {_stats('k_')} FROM (SELECT model, chart, block, sum(a) AS a, sum(b) AS b, sum(c) AS c, {', '.join(f'avg(m_{m}) AS k_{m}' for m in M)} FROM (SELECT model, chart, label, block, count(*) AS a, count_if(has_output) AS b, count_if(correct_output_size) AS c, {', '.join(f'avg({m}) AS m_{m}' for m in M)} FROM cpl GROUP BY ALL) GROUP BY ALL) GROUP BY model, block"""))
def rollup_chart_levels(spark, sf_dir):
    out = rounded(rollup.chart_levels(chart_long(spark, sf_dir)))
    return out.select("level", "model", "category", "task", "n_tasks", "block", *rollup.COUNTS, *rollup.STATS)


@query(with_sql("prob", query=f"SELECT task, {_COUNTS} FROM prob GROUP BY ALL"))
def base_counts(spark, sf_dir):
    return derive.problems(spark, sf_dir).groupBy("task").agg(*rollup.counts())


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(coalesce(stddev_pop(c_acctbal), 0), 6) AS std FROM customer GROUP BY ALL")
def std_population(spark, sf_dir):
    return derive.read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.stddev_pop("c_acctbal"), F.lit(0.0)), 6).alias("std"))


@query(with_sql(*LONG, query="""SELECT model, block, avg(has_output::INT) AS prop_with_output, avg(CASE WHEN has_output THEN correct_output_size::INT END) AS prop_same_dimensions, round(avg(CASE WHEN has_output THEN iou END), 9) AS mean_iou,
    round(avg(CASE WHEN has_output THEN (iou >= 0.99e0)::INT END), 9) AS share_99, round(avg(CASE WHEN has_output THEN (iou >= 0.95e0)::INT END), 9) AS share_95 FROM pl GROUP BY ALL""").replace("avg(has_output::INT) AS", "round(avg(has_output::INT), 9) AS").replace("avg(CASE WHEN has_output THEN correct_output_size::INT END) AS", "round(avg(CASE WHEN has_output THEN correct_output_size::INT END), 9) AS"))
def agg_outputs_only(spark, sf_dir):
    has, iou = F.col("has_output"), F.col("iou")
    return long(spark, sf_dir).groupBy("model", "block").agg(
        F.round(F.avg(has.cast("int")), 9).alias("prop_with_output"), F.round(F.avg(F.when(has, F.col("correct_output_size").cast("int"))), 9).alias("prop_same_dimensions"),
        F.round(F.avg(F.when(has, iou)), 9).alias("mean_iou"), F.round(F.avg(F.when(has, (iou >= 0.99).cast("int"))), 9).alias("share_99"), F.round(F.avg(F.when(has, (iou >= 0.95).cast("int"))), 9).alias("share_95"),
    )


@query(with_sql(*LONG, query="""SELECT model, task, level_pct::INT AS level_pct, count_if(has_output AND iou * 100 >= level_pct) AS n_pass, count_if(has_output) AS n_out, round(count_if(has_output AND iou * 100 >= level_pct) / nullif(count_if(has_output), 0), 9) AS pass_rate
    FROM pl, range(0, 101, 10) AS r(level_pct) WHERE block = '2' GROUP BY ALL"""))
def pass_rate_sweep(spark, sf_dir):
    l = long(spark, sf_dir).where("block = '2'")
    levels = list(range(0, 101, 10))
    g = l.groupBy("model", "task").agg(F.count_if("has_output").alias("n_out"), *(F.count_if(F.col("has_output") & (F.col("iou") * 100 >= p)).alias(f"n{p}") for p in levels))
    rows = F.array(*(F.struct(F.lit(p).alias("level_pct"), F.col(f"n{p}").alias("n_pass")) for p in levels))
    return g.select("model", "task", "n_out", F.explode(rows).alias("x")).select("model", "task", "x.*", "n_out", F.round(F.try_divide(F.col("x.n_pass"), F.col("n_out")), 9).alias("pass_rate"))


# -- bootstrap ---------------------------------------------------------------------------------------

#: Resamples of levels 2 and 3 in the SQL form, as their SQL has them; level 1 and the numpy form take all ``bootstrap.N_BOOT``.
N_SQL = 100


def _boot_sql(keys: list[str], levels: list[str], n_boot: int = N_SQL) -> str:
    leaf = [*keys, *levels]
    units = [k for k in leaf if k != "block"]
    c = ", ".join
    level = f"SELECT {c(f'r.{k}' for k in leaf)}, b, {c(f'avg({m}) AS {m}' for m in M[:3])} FROM rk r JOIN dr d ON {' AND '.join(f'r.{k} = d.{k}' for k in units)} AND r.pos = d.pos GROUP BY ALL"
    for depth in range(len(levels) - 1, -1, -1):
        level = f"SELECT {c([*keys, *levels[:depth]])}, b, {c(f'avg({m}) AS {m}' for m in M[:3])} FROM ({level}) GROUP BY ALL"
    return with_sql(*LONG, query=f"""
    , rk AS (SELECT {c(leaf)}, row_number() OVER (PARTITION BY {c(leaf)} ORDER BY sid) AS pos, count(*) OVER (PARTITION BY {c(leaf)}) AS n, {c(M[:3])} FROM pl),
    dr AS (SELECT {c(units)}, b, ('0x' || substr(md5(concat_ws('|', '{bootstrap.SEED}', {c(units)}, b, i)), 1, 8))::BIGINT % n + 1 AS pos FROM (SELECT DISTINCT {c(units)}, n FROM rk), range(1, {n_boot + 1}) AS bb(b), LATERAL (SELECT unnest(range(1, n + 1)) AS i))
    SELECT {c(keys)}, {c(f"round(quantile_cont({m}, {p}), 9) AS ci95_{m}_{e}" for m in M[:3] for e, p in (("low", 0.025), ("high", 0.975)))} FROM ({level}) GROUP BY ALL""")


@query(_boot_sql(["model", "task", "block"], [], bootstrap.N_BOOT))
def bootstrap_l1_sql(spark, sf_dir):
    return bootstrap.draws_sql_form(long(spark, sf_dir, once=True), ["model", "task", "block"], [], ["sid"], bootstrap.N_BOOT)


@query(_boot_sql(["model", "category", "block"], ["task"]))
def bootstrap_l2_sql(spark, sf_dir):
    return bootstrap.draws_sql_form(long(spark, sf_dir, once=True), ["model", "category", "block"], ["task"], ["sid"], N_SQL)


@query(_boot_sql(["model", "block"], ["category", "task"]))
def bootstrap_l3_sql(spark, sf_dir):
    return bootstrap.draws_sql_form(long(spark, sf_dir, once=True), ["model", "block"], ["category", "task"], ["sid"], N_SQL)


@query()
def bootstrap_l1_numpy(spark, sf_dir):
    return rounded(bootstrap.intervals(long(spark, sf_dir), ["model", "task", "block"], [], ["sid"]))


@query()
def bootstrap_l2_numpy(spark, sf_dir):
    return rounded(bootstrap.intervals(long(spark, sf_dir), ["model", "category", "block"], ["task"], ["sid"]))


@query()
def bootstrap_l3_numpy(spark, sf_dir):
    return rounded(bootstrap.intervals(long(spark, sf_dir), ["model", "block"], ["category", "task"], ["sid"]))


# -- leaderboard and report ---------------------------------------------------------------------------

@query(with_sql(*LONG, "r_task", "r_cat", "r_bench", query="""SELECT category, r_cat.model, round(r_cat.mean_iou, 9) AS iou, round(r_bench.mean_iou, 9) AS overall, rank() OVER (PARTITION BY category ORDER BY round(r_cat.mean_iou, 9) DESC) AS place,
    dense_rank() OVER (ORDER BY round(r_bench.mean_iou, 9) DESC, r_cat.model) AS overall_place FROM r_cat JOIN r_bench ON r_cat.model = r_bench.model AND r_cat.block = r_bench.block WHERE r_cat.block = 'mean'"""))
def model_leaderboard(spark, sf_dir):
    """Which model edits best, by category and over all."""
    task = rollup.micro(long(spark, sf_dir).where("block = 'mean'"), ["model", "category", "task"])
    cat = rollup.macro(task, ["model", "category"])
    bench = rollup.macro(cat.drop("n_tasks"), ["model"]).select("model", F.round("mean_iou", 9).alias("overall"))
    rows = cat.select("category", "model", F.round("mean_iou", 9).alias("iou")).join(bench, "model")
    return rows.select(
        "category", "model", "iou", "overall", F.rank().over(Window.partitionBy("category").orderBy(F.desc("iou"))).cast("long").alias("place"),
        F.dense_rank().over(Window.orderBy(F.desc("overall"), "model")).cast("long").alias("overall_place"),
    )


@query(with_sql(*LONG, "r_task", query="SELECT task, model, round(mean_iou, 9) AS iou, rank() OVER (PARTITION BY task ORDER BY round(mean_iou, 3) DESC) = 1 AS best FROM r_task WHERE block = '5' AND mean_iou IS NOT NULL"))
def best_model_ties(spark, sf_dir):
    t = rollup.micro(long(spark, sf_dir).where("block = '5'"), ["model", "category", "task"]).where("mean_iou IS NOT NULL")
    best = F.rank().over(Window.partitionBy("task").orderBy(F.round("mean_iou", 3).desc())) == 1
    return t.select("task", "model", F.round("mean_iou", 9).alias("iou"), best.alias("best"))


@query(with_sql(*LONG, "r_task", query="SELECT model, task, CASE WHEN n_with_output = 0 THEN '—' ELSE printf('%.1f%%', round(mean_iou, 9) * 100) END AS cell, printf('%d / %d', n_with_output, n_problems) AS counts FROM r_task WHERE block = 'mean'"))
def format_cells(spark, sf_dir):
    t = rollup.micro(long(spark, sf_dir).where("block = 'mean'"), ["model", "category", "task"])
    cell = F.when(F.col("n_with_output") == 0, "—").otherwise(F.format_string("%.1f%%", F.round("mean_iou", 9) * 100))
    return t.select("model", "task", cell.alias("cell"), F.format_string("%d / %d", "n_with_output", "n_problems").alias("counts"))


@query(with_sql("prob", query="SELECT visual_condition AS mode, n, row_number() OVER (ORDER BY visual_condition <> 'baseline', visual_condition) AS ord FROM (SELECT visual_condition, count(*) AS n FROM prob GROUP BY ALL)"))
def mode_order_baseline_first(spark, sf_dir):
    g = derive.problems(spark, sf_dir).groupBy(F.col("visual_condition").alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("ord", F.row_number().over(Window.orderBy(F.col("mode") != "baseline", "mode")).cast("long"))


@query(with_sql(*LONG, query="SELECT DISTINCT category, task FROM pl WHERE block = 'mean' AND category IS NOT NULL"))
def semi_main_tasks(spark, sf_dir):
    main = dims.tasks(spark).select("task")
    return long(spark, sf_dir).where("block = 'mean'").join(F.broadcast(main), "task", "left_semi").select("category", "task").distinct()
