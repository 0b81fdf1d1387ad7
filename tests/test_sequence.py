"""The total order without one task, and scores that several levels share."""

from __future__ import annotations

import random

from pixelloom.operators import sequence
from pixelloom.plans import q_planning, q_scoring


def test_global_order_with_ties_nulls_and_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(3_000)] + [("hot", 7, 5_000 + i) for i in range(4_000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = sorted(sequence.global_order(df, ["k", "v"], "ord").collect(), key=lambda r: r["ord"])
    assert [r["ord"] for r in got] == list(range(1, 7_001)) and {r["i"] for r in got} == {i for _, _, i in rows}
    keys = [(r["k"] is not None, r["k"] or "", r["v"]) for r in got]
    assert keys == sorted(keys)
    assert sequence.global_order(df.limit(0), ["k", "v"], "ord").count() == 0


def test_windows_run_over_ranges_only(spark, sf_dir):
    plan = q_planning.problem_stats_sorted(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert plan.count("Window") == 1 and window.index("HashAggregate") < window.index("FileScan"), "one row a range is numbered, not a row an event"


def test_levels_share_one_scan(spark, sf_dir):
    for q in (q_scoring.rollup_all_levels, q_scoring.rollup_mode, q_scoring.rollup_chart_levels):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "scores" in plan
