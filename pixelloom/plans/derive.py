"""Problem-shaped relations over the benchmark tables.

The tables hold no images, so pixels, problems, scenes, charts and inference logs are derived
from them by fixed arithmetic; the same relations are written as SQL in ``SQL`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

TASK_NAMES = tuple(dims.TASKS)
COND_NAMES = tuple(dims.CONDITIONS)
CHART_NAMES = tuple(dims.CHARTS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sid, input (ir..), answer (ar..) and output (pr..) channels: one row per line item."""
    li = read(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("int")
    px = li.select(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("sid"), qty.alias("q"), (F.col("l_linenumber") <= 2).alias("edit"),
        (F.col("l_partkey") * 37 % 256).cast("int").alias("ir"), (F.col("l_orderkey") * 91 % 256).cast("int").alias("ig"),
        ((F.col("l_partkey") + F.col("l_orderkey")) * 53 % 256).cast("int").alias("ib"),
    )
    answer = {c: F.when(F.col("edit"), 255 - F.col(f"i{c}")).otherwise(F.col(f"i{c}")) for c in "rgb"}
    px = px.select("*", *(v.alias(f"a{c}") for c, v in answer.items()))
    base = {c: F.when(F.col("q") % 2 == 0, F.col(f"a{c}")).otherwise(F.col(f"i{c}")) for c in "rgb"}
    red = F.greatest(F.lit(0), F.least(F.lit(255), base["r"] + (F.col("q") % 7 - 3)))
    return px.select("model", "sid", "ir", "ig", "ib", "ar", "ag", "ab", red.alias("pr"), base["g"].alias("pg"), base["b"].alias("pb"))


#: So that groups are uneven, the fourth task of the later suppliers goes to the fifth, and the seventh chart task to the eighth.
_UNEVEN, _UNEVEN_CHART = (3, 3), (6, 2)


def _kind(uneven: tuple[int, int]) -> Column:
    """Number of a supplier's task (0 to 19)."""
    task, most = uneven
    k = F.col("sid") % 20
    return F.when((k == task) & (F.floor(F.col("sid") / 20) >= most), task + 1).otherwise(k)


def _kind_sql(uneven: tuple[int, int]) -> str:
    task, most = uneven
    return f"CASE WHEN s_suppkey % 20 = {task} AND s_suppkey // 20 >= {most} THEN {task + 1} ELSE s_suppkey % 20 END"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, task, category, visual_condition, mode, has_output, correct_output_size (null without output): a problem for every supplier."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid")).withColumn("kind", _kind(_UNEVEN))
    turn = F.floor(F.col("sid") / 20)
    modes = F.array(*(dims.names(m) for _, m in dims.TASKS.values()))
    own = F.element_at(modes, (F.col("kind") + 1).cast("int"))
    out = s.select(
        "sid", dims.pick(TASK_NAMES, F.col("kind")).alias("task"), dims.pick([c for c, _ in dims.TASKS.values()], F.col("kind")).alias("category"),
        dims.pick(COND_NAMES, turn % 8).alias("visual_condition"), F.element_at(own, (turn % F.size(own) + 1).cast("int")).alias("mode"),
        (F.col("sid") % 17 != 0).alias("has_output"),
    )
    return out.withColumn("correct_output_size", F.when(F.col("has_output"), F.col("sid") % 5 != 0))


def chart_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, task (chart_subtask), has_output, correct_output_size: one for every supplier."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid")).withColumn("kind", _kind(_UNEVEN_CHART))
    all_tasks = [f"{c}_{t}" for c, subs in dims.CHARTS.items() for t in subs]
    out = s.select("sid", dims.pick(all_tasks, F.col("kind")).alias("task"), (F.col("sid") % 17 != 0).alias("has_output"))
    return out.withColumn("correct_output_size", F.when(F.col("has_output"), F.col("sid") % 5 != 0))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, z, shape, fill, x, y, w, h, rotation: ten shapes a scene."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.floor(k / 10).cast("long").alias("scene"), (k % 10).cast("int").alias("z"), dims.pick(dims.SHAPES, F.col("p_size") % 12).alias("shape"),
        dims.pick(dims.PALETTE, k % 11).alias("fill"), (k * 7 % 80).cast("int").alias("x"), (k * 13 % 80).cast("int").alias("y"),
        (8 + F.col("p_size") % 17).cast("int").alias("w"), (8 + k % 19).cast("int").alias("h"), (k * 15 % 360).cast("int").alias("rotation"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i (place in time), y: one series a user."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("y"), "event_type")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart (nation), ord, name (segment), value: sums of balances, rounded."""
    from pyspark.sql.window import Window

    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("chart"), F.col("c_mktsegment").alias("name")).agg(F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("value"))
    return c.select("chart", (F.row_number().over(Window.partitionBy("chart").orderBy("name")) - 1).cast("long").alias("ord"), "name", "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, v of a heatmap with holes (null v) where few parts fall."""
    g = read(spark, sf_dir, "part").groupBy((F.col("p_size") % 8).cast("int").alias("r"), (F.col("p_partkey") % 9).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"))
    return g.select("r", "c", F.when(F.col("n") % 4 != 0, F.round("m", 4)).alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i < j: undirected nation pairs that customers and orders make more often than the average pair."""
    from pyspark.sql.window import Window

    o = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("other"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("own"))
    e = o.join(c, o["o_custkey"] == c["c_custkey"]).where("own <> other")
    pairs = e.groupBy(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("m", F.avg("n").over(Window.partitionBy(F.lit(1)))).where("n > m").select("i", "j")  # at most 300 pairs


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference log: task, idx, success, skipped, latency (null if skipped or failed), error."""
    return runs_of(read(spark, sf_dir, "events"))


def runs_of(e: DataFrame) -> DataFrame:
    """``runs`` of events, which may be a stream."""
    ok = F.col("event_type") != "error"
    skipped = F.col("event_type") == "signup"
    return e.select(
        dims.pick(TASK_NAMES, F.col("event_id") % 20).alias("task"), F.floor(F.col("event_id") / 20).cast("long").alias("idx"), ok.alias("success"), skipped.alias("skipped"),
        F.when(ok & ~skipped, F.round(F.col("value") / 100, 4)).alias("latency"),
        F.when(~ok, dims.pick(("HTTP 429 Too Many Requests", "invalid prompt", "Read timed out", "503 Service Unavailable", "bad image"), F.col("event_id") % 5)).alias("error"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (model, task, idx): times of the files of one evaluation, and the sidecar's size; null: no such file."""
    e = read(spark, sf_dir, "events")
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return e.select(
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), dims.pick(TASK_NAMES, F.floor(k / 3) % 20).alias("task"), F.floor(k / 60).cast("long").alias("idx"),
        t.alias("input_t"), (t + k % 7).alias("answer_t"), F.when(k % 11 != 0, t + k % 13).alias("output_t"),
        F.when(k % 5 != 0, t + k % 17).alias("sidecar_t"), F.when(k % 5 != 0, k % 4 * 100).alias("sidecar_len"), (k % 3 != 0).alias("marker"),
    )


SQL = {
    "px": """px0 AS (SELECT l_returnflag AS model, l_suppkey AS sid, l_quantity::INT AS q, l_linenumber <= 2 AS edit, (l_partkey * 37 % 256)::INT AS ir,
        (l_orderkey * 91 % 256)::INT AS ig, ((l_partkey + l_orderkey) * 53 % 256)::INT AS ib FROM lineitem),
    px1 AS (SELECT *, CASE WHEN edit THEN 255 - ir ELSE ir END AS ar, CASE WHEN edit THEN 255 - ig ELSE ig END AS ag, CASE WHEN edit THEN 255 - ib ELSE ib END AS ab FROM px0),
    px AS (SELECT model, sid, ir, ig, ib, ar, ag, ab, greatest(0, least(255, CASE WHEN q % 2 = 0 THEN ar ELSE ir END + (q % 7 - 3))) AS pr,
        CASE WHEN q % 2 = 0 THEN ag ELSE ig END AS pg, CASE WHEN q % 2 = 0 THEN ab ELSE ib END AS pb FROM px1)""",
    "prob": f"""prob0 AS (SELECT s_suppkey AS sid, s_suppkey // 20 AS turn, {_kind_sql(_UNEVEN)} AS kind FROM supplier),
    prob AS (SELECT sid, task, category, {dims.sql_list(COND_NAMES)}[turn % 8 + 1] AS visual_condition, modes[turn % len(modes) + 1] AS mode, sid % 17 <> 0 AS has_output,
        CASE WHEN sid % 17 <> 0 THEN sid % 5 <> 0 END AS correct_output_size FROM prob0 JOIN {dims.sql_tasks()} ON dim_task.ord = kind)""",
    "cprob": f"""cprob AS (SELECT s_suppkey AS sid, {dims.sql_list([f"{c}_{t}" for c, s in dims.CHARTS.items() for t in s])}[{_kind_sql(_UNEVEN_CHART)} + 1] AS task, s_suppkey % 17 <> 0 AS has_output,
        CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey % 5 <> 0 END AS correct_output_size FROM supplier)""",
    "shapes": f"""shapes AS (SELECT p_partkey // 10 AS scene, (p_partkey % 10)::INT AS z, {dims.sql_list(dims.SHAPES)}[p_size % 12 + 1] AS shape, {dims.sql_list(dims.PALETTE)}[p_partkey % 11 + 1] AS fill,
        (p_partkey * 7 % 80)::INT AS x, (p_partkey * 13 % 80)::INT AS y, (8 + p_size % 17)::INT AS w, (8 + p_partkey % 19)::INT AS h, (p_partkey * 15 % 360)::INT AS rotation FROM part)""",
    "series": "series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS y, event_type FROM events)",
    "bars": """bars AS (SELECT chart, row_number() OVER (PARTITION BY chart ORDER BY name) - 1 AS ord, name, value FROM
        (SELECT c_nationkey AS chart, c_mktsegment AS name, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS value FROM customer GROUP BY ALL))""",
    "grid": """grid AS (SELECT r, c, CASE WHEN n % 4 <> 0 THEN round(m, 4) END AS v FROM (SELECT (p_size % 8)::INT AS r, (p_partkey % 9)::INT AS c, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY ALL))""",
    "edges": """edges AS (SELECT i, j FROM (SELECT *, avg(n) OVER () AS m FROM (SELECT least(own, other) AS i, greatest(own, other) AS j, count(*) AS n FROM
        (SELECT c_nationkey::INT AS own, (o_orderkey % 25)::INT AS other FROM orders JOIN customer ON o_custkey = c_custkey) WHERE own <> other GROUP BY ALL)) WHERE n > m)""",
    "runs": f"""runs AS (SELECT {dims.sql_list(TASK_NAMES)}[event_id % 20 + 1] AS task, event_id // 20 AS idx, event_type <> 'error' AS success, event_type = 'signup' AS skipped,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN round(value / 100, 4) END AS latency,
        CASE WHEN event_type = 'error' THEN ['HTTP 429 Too Many Requests', 'invalid prompt', 'Read timed out', '503 Service Unavailable', 'bad image'][event_id % 5 + 1] END AS error FROM events)""",
    "files": f"""files AS (SELECT 'm' || (event_id % 3) AS model, {dims.sql_list(TASK_NAMES)}[event_id // 3 % 20 + 1] AS task, event_id // 60 AS idx, t AS input_t, t + event_id % 7 AS answer_t,
        CASE WHEN event_id % 11 <> 0 THEN t + event_id % 13 END AS output_t, CASE WHEN event_id % 5 <> 0 THEN t + event_id % 17 END AS sidecar_t,
        CASE WHEN event_id % 5 <> 0 THEN event_id % 4 * 100 END AS sidecar_len, event_id % 3 <> 0 AS marker FROM (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events))""",
}


def with_sql(*names: str, query: str) -> str:
    """A query over derived relations as one SQL text."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
