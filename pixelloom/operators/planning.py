"""Plans of evaluation and inference: what is there, what is stale, what failed, what to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import TRANSIENT


def eval_plan(problems: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Every problem with its output, if any."""
    return problems.join(outputs, keys, "left")


def is_fresh(need_marker: bool = True) -> Column:
    """The sidecar exists, isn't empty, and is no older than any of its sources that exist."""
    newest = F.greatest(F.col("input_t"), F.col("answer_t"), F.coalesce("output_t", "answer_t"))
    ok = F.col("sidecar_t").isNotNull() & (F.coalesce("sidecar_len", F.lit(0)) > 0) & (F.col("sidecar_t") >= newest)
    return ok & F.col("marker") if need_marker else ok


def partition_cached(plan: DataFrame, parsed: Column) -> DataFrame:
    """``action``: reuse what is fresh and parses, recompute the rest (a corrupt cache too)."""
    return plan.withColumn("action", F.when(is_fresh() & parsed, "reuse").otherwise("compute"))


def plan_summary(plan: DataFrame, keys: list[str], cached: Column) -> DataFrame:
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(cached).alias("cached"))


def first_per_group(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; 0 means all.  Spark keeps only those of each task."""
    if not limit:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def failed(runs: DataFrame) -> DataFrame:
    return runs.where(~F.coalesce("success", F.lit(False)))


def is_transient(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    hit = F.lit(False)
    for m in TRANSIENT:
        hit = hit | low.contains(m)
    return hit


def inference_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and latencies (nulls don't count) per group; no keys: over all."""
    t = F.col("latency")
    ok, skipped = F.col("success"), F.coalesce("skipped", F.lit(False))
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_problems"), F.count_if(ok).alias("num_successful"), F.count_if(skipped).alias("num_skipped"),
        F.round(F.avg(t), 4).alias("avg_s"), F.round(F.percentile(t, F.lit(0.5)), 4).alias("median_s"), F.round(F.min(t), 4).alias("min_s"), F.round(F.max(t), 4).alias("max_s"), F.sum(t).alias("_sum"),
    )
    new = F.col("num_problems") - F.col("num_skipped")
    new_ok = F.col("num_successful") - F.col("num_skipped")
    return out.select(
        *keys, "num_problems", "num_successful", "num_skipped", "avg_s", "median_s", "min_s", "max_s", F.round(F.try_divide(F.col("num_successful"), F.col("num_problems")), 6).alias("success_rate"),
        F.round(F.try_divide(new_ok, new), 6).alias("new_run_success_rate"), F.round(F.try_divide(new_ok * 60.0, F.round("_sum", 6)), 4).alias("throughput_per_min"),
    )


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Upsert: of each key the row of the latest time wins (partial maxima, no sort)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(time)).alias("_r")).select(*keys, "_r.*")


# -- layered settings ------------------------------------------------------------------------------

#: What a setting may come from, the weakest first; the first two hold for every variant.
LAYERS = ("default", "global", "variant", "argument")
SHARED = ("default", "global")


def resolved(settings: DataFrame, order: str) -> DataFrame:
    """name, variant, value, layer: for each setting and variant the value of the strongest layer that has one.

    ``settings``: name, variant, layer, value and ``order``, of which the last says in one layer.  Null and empty values say nothing, so that the
    next layer holds; what is set for all variants reaches the variants that any row of that name mentions.  A setting without any value is null, of a null layer.
    """
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    said = settings.withColumn("_rank", F.when((F.col("value") != "") & (rank > 0), rank))
    best = F.max_by(F.struct("value", "layer", F.col("_rank").alias("rank")), F.when(F.col("_rank").isNotNull(), F.struct("_rank", order)))
    shared = F.coalesce(F.col("layer").isin(*SHARED), F.lit(False))
    own = said.where(~shared & F.col("variant").isNotNull()).groupBy("name", "variant").agg(best.alias("own"))
    common = said.where(shared).groupBy("name").agg(best.alias("common"))
    both = own.join(common, "name", "left")
    pick = F.when(F.col("own.rank").isNotNull(), F.col("own")).otherwise(F.col("common"))
    return both.select("name", "variant", pick["value"].alias("value"), F.when(pick["rank"].isNotNull(), pick["layer"]).alias("layer"))


def truth(value: Column) -> Column:
    """A setting's text as a boolean: ``0``, ``false``, ``no`` and the empty text are false, whatever their case; null stays null."""
    return ~F.lower(value).isin("0", "false", "no", "")
