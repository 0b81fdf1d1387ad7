"""Rollup and bootstrap on records that can be checked by hand."""

from __future__ import annotations

import numpy as np
import pytest

from pixelloom.operators import bootstrap, rollup

COLUMNS = "model string, category string, task string, mode string, visual_condition string, idx int, has_output boolean, correct_output_size boolean, block string, edit_accuracy double, preservation_accuracy double, iou double, changed_pixels double"


def records(spark, groups):
    """groups: (category, task, mode, condition, [iou])."""
    rows = [("m", c, t, m, v, i, True, True, "mean", 0.8, 0.9, x, 0.0) for c, t, m, v, xs in groups for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, COLUMNS)


def levels(df):
    out = {}
    for r in rollup.all_levels(df).collect():
        out.setdefault(r["level"], []).append(r)
    return out


def test_levels_of_a_task_with_two_modes(spark):
    got = levels(records(spark, [("g", "translation", m, "baseline", [0.5] * 3) for m in ("align", "amount")]))
    assert {k: len(v) for k, v in got.items()} == {"mode": 2, "task": 1, "category": 1, "visual_condition": 1, "benchmark": 1}


def test_single_mode_has_no_mode_row(spark):
    assert "mode" not in levels(records(spark, [("s", "construction", "line", "baseline", [1.0])]))


def test_tasks_weigh_the_same(spark):
    got = levels(records(spark, [("c", "blending", "default", "baseline", [1.0] * 3), ("c", "gradient", "default", "baseline", [0.0])]))
    assert got["category"][0]["mean_iou"] == 0.5 and got["visual_condition"][0]["mean_iou"] == 0.5 and got["benchmark"][0]["mean_iou"] == 0.5
    assert got["category"][0]["n_tasks"] == 2 and got["benchmark"][0]["n_tasks"] == 1 and got["benchmark"][0]["n_problems"] == 4


def test_benchmark_is_macro_over_categories(spark):
    got = levels(records(spark, [*(("color", f"t{i}", "default", "b", [0.2]) for i in range(3)), ("geo", "rotation", "default", "b", [0.8])]))
    assert got["benchmark"][0]["mean_iou"] == pytest.approx(0.5)


def test_diagnostic_task_has_a_task_row_only(spark):
    got = levels(records(spark, [("g", "translation", "align", "b", [0.5]), (None, "preservation", "default", "b", [1.0])]))
    assert sorted(r["task"] for r in got["task"]) == ["preservation", "translation"]
    assert len(got["category"]) == 1 and got["benchmark"][0]["mean_iou"] == 0.5


def test_missing_outputs_count_as_problems(spark):
    rows = [("m", "g", "t", "default", "b", i, i != 0, None if i == 0 else i != 1, "mean", 0.0, 0.0, 0.0, 0.0) for i in range(7)] + [("m", "g", "t", "default", "b", 8, None, True, "mean", 0.0, 0.0, 0.0, 0.0)]
    r = rollup.micro(spark.createDataFrame(rows, COLUMNS), ["task"]).first()
    assert (r["n_problems"], r["n_with_output"], r["n_correct_output_size"]) == (8, 7, 6)


def test_population_deviation(spark):
    r = rollup.micro(records(spark, [("g", "t", "d", "b", [0.1, 0.4, 0.7])]), ["task"]).first()
    assert r["std_iou"] == pytest.approx(np.std([0.1, 0.4, 0.7])) and rollup.micro(records(spark, [("g", "t", "d", "b", [0.3])]), ["task"]).first()["std_iou"] == 0


def test_interval_of_constant_data_has_no_width():
    got = bootstrap.nested_interval(np.full((10, 3), 0.6), 200)
    assert np.allclose(got, 0.6)


def test_interval_is_macro_not_pooled():
    a, b = np.full((10, 3), 0.2), np.full((2, 3), 0.8)
    assert np.allclose(bootstrap.nested_interval([a, b], 100), 0.5)
    assert np.allclose(bootstrap.nested_interval([[a, b], [np.full((5, 3), 0.5)]], 100), 0.5)


def test_interval_contains_the_mean_and_follows_the_stream():
    x = np.array([0.2, 0.5, 0.7, 0.9, 0.4])[:, None].repeat(3, 1)
    lo, hi = bootstrap.nested_interval(x, 2000, 42)
    assert (lo <= x.mean(0)).all() and (hi >= x.mean(0)).all()
    index = np.random.default_rng(42).integers(0, 5, size=(2000, 5))
    assert np.allclose([lo[0], hi[0]], np.percentile(x[:, 0][index].mean(1), [2.5, 97.5]))


def test_empty_groups_are_skipped():
    assert np.allclose(bootstrap.nested_interval([np.zeros((0, 3)), np.full((3, 3), 0.4)], 50), 0.4)
    assert (bootstrap.nested_interval([], 50) == 0).all()


def test_grouped_map_equals_plain_call(spark):
    d = records(spark, [("g", t, "d", "b", xs) for t, xs in (("a", [0.1, 0.9, 0.4]), ("b", [0.3, 0.2]))])
    r = bootstrap.intervals(d, ["model", "block"], ["task"], ["idx"], 500, 7).first()
    arr = lambda xs: np.array([[0.8, 0.9, x] for x in xs])
    want = bootstrap.nested_interval([arr([0.1, 0.9, 0.4]), arr([0.3, 0.2])], 500, 7)
    assert (r["ci95_iou_low"], r["ci95_iou_high"]) == pytest.approx((want[0, 2], want[1, 2]))


def test_indices_are_drawn_in_pieces_of_one_stream():
    class Watched:
        def __init__(self):
            self.rng, self.most = np.random.default_rng(42), 0

        def integers(self, low, high, size):
            self.most = max(self.most, size[0] * size[1])
            return self.rng.integers(low, high, size=size)

    x = np.random.default_rng(1).random((37, 3))
    watched = Watched()
    got = bootstrap.resampled_means(x, watched, 1_001, cells=37 * 3 * 10)
    assert watched.most <= 37 * 10
    assert np.array_equal(got, x[np.random.default_rng(42).integers(0, 37, size=(1_001, 37))].mean(1))


def test_registered_numpy_intervals_take_all_iterations(spark, monkeypatch):
    from pixelloom.plans import q_scoring

    d = records(spark, [("g", t, "d", "b", xs) for t, xs in (("a", [0.1, 0.9, 0.4]), ("b", [0.3, 0.2]))]).withColumnRenamed("idx", "sid")
    monkeypatch.setattr(q_scoring, "long", lambda spark, sf_dir: d)
    arr = lambda xs: np.array([[0.8, 0.9, x] for x in xs])
    a, b = arr([0.1, 0.9, 0.4]), arr([0.3, 0.2])
    wanted = {"l1": bootstrap.nested_interval(a, 10_000), "l2": bootstrap.nested_interval([a, b], 10_000), "l3": bootstrap.nested_interval([[a, b]], 10_000)}
    for level, want in wanted.items():
        rows = getattr(q_scoring, f"bootstrap_{level}_numpy")(spark, "").collect()
        r = next(r for r in rows if level != "l1" or r["task"] == "a")
        assert (r["ci95_iou_low"], r["ci95_iou_high"]) == pytest.approx((want[0, 2], want[1, 2]), abs=1e-8)


def test_draws_are_joined_by_sorting(spark):
    """Draws are many times the problems they come from, so that by the file's size they would be sent to all tasks."""
    from pixelloom.operators import bootstrap

    rows = spark.range(30).selectExpr("'m' AS model", "'t' AS task", "'0' AS block", "id AS sid", *(f"id / 30 AS {m}" for m in bootstrap.CI_METRICS))
    out = bootstrap.draws_sql_form(rows, ["model", "task", "block"], [], ["sid"], 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == 1


def test_blocks_without_levels_are_resampled_together(spark):
    """The same intervals as block by block, from one group a task: blocks of other problems among them."""
    from pixelloom.operators import bootstrap

    rng = np.random.default_rng(5)
    vals = {(b, k): rng.random(3).tolist() for b, n in (("0", 9), ("1", 9), ("mean", 4)) for k in range(n)}
    d = spark.createDataFrame([("m", "t", b, k, *v) for (b, k), v in vals.items()], "model string, task string, block string, sid int, edit_accuracy double, preservation_accuracy double, iou double")
    out = bootstrap.intervals(d, ["model", "task", "block"], [], ["sid"], 300)
    grouped = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in x][0]
    assert "block" not in grouped.split("]")[0]
    for r in out.collect():
        own = np.array([v for (b, _), v in sorted(vals.items()) if b == r["block"]])
        want = bootstrap.nested_interval(own, 300).T.ravel()
        assert np.allclose([r[f"ci95_{m}_{e}"] for m in bootstrap.CI_METRICS for e in ("low", "high")], want, atol=1e-12)
    assert out.count() == 3


def test_keyed_draws_are_those_of_md5():
    """Numbers of other lengths, a group that doesn't fill a tile, and a name that needs a second block."""
    import hashlib

    for name, first, last, n in (("42|m|t", 95, 120, 1_003), ("42|m|t", 9_999, 10_000, 17_000), ("42|" + "y" * 60, 8, 11, 12)):
        got = bootstrap.key_draws(name, first, last, n)
        for b in (first, last):
            assert got[b - first].tolist() == [int(hashlib.md5(f"{name}|{b}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(1, n + 1)]


def test_registered_sql_interval_takes_all_iterations(spark, monkeypatch):
    import hashlib

    from pixelloom import catalog
    from pixelloom.plans import q_scoring

    xs = [0.1, 0.9, 0.4, 0.35, 0.7]
    d = records(spark, [("g", "a", "d", "b", xs)]).withColumnRenamed("idx", "sid")
    monkeypatch.setattr(q_scoring, "long", lambda spark, sf_dir, once=False: d)
    pick = lambda b, i: int(hashlib.md5(f"{bootstrap.SEED}|m|a|{b}|{i}".encode()).hexdigest()[:8], 16) % 5
    want = np.percentile([np.mean([xs[pick(b, i)] for i in range(1, 6)]) for b in range(1, 10_001)], [2.5, 97.5])
    r = q_scoring.bootstrap_l1_sql(spark, "").first()
    assert (r["ci95_iou_low"], r["ci95_iou_high"]) == pytest.approx(tuple(want), abs=1e-9)
    assert "range(1, 10001)" in catalog.oracle_sql()["bootstrap_l1_sql"]


def test_draws_don_t_depend_on_parts_and_pieces(spark, monkeypatch):
    """Blocks of two sizes with missing values, as a join of draws and problems by place gives them."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [("m", t, b, k, *(None if (k, b) == (2, "0") else float(x) for x in rng.random(3))) for t, m in (("s", 7), ("t", 9)) for b, n in (("0", m), ("1", m), ("mean", 4)) for k in range(n)]
    d = spark.createDataFrame(rows, "model string, task string, block string, sid int, edit_accuracy double, preservation_accuracy double, iou double")
    one = lambda **o: {(r["model"], r["task"], r["block"]): tuple(r)[3:] for r in bootstrap.draws_sql_form(d, ["model", "task", "block"], [], ["sid"], 60, **o).collect()}
    got = one()
    monkeypatch.setattr(bootstrap, "PIECE", 3)
    again = one(draws=40)
    assert len(got) == 6 and again.keys() == got.keys() and all(again[k] == pytest.approx(v, abs=1e-12) for k, v in got.items())
    for t, m in (("s", 7), ("t", 9)):
        draws = {b: [int(hashlib.md5(f"42|m|{t}|{b}|{i}".encode()).hexdigest()[:8], 16) % n for n in (4, m) for i in range(1, n + 1)] for b in range(1, 61)}
        for block in ("0", "mean"):
            own = {r[3]: r[6] for r in rows if r[1:3] == (t, block) and r[6] is not None}
            means = [np.mean(taken) for at in draws.values() if (taken := [own[k] for k in at if k in own])]
            assert got["m", t, block][4:] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)
    both = bootstrap.draws_sql_form(d, ["model", "block"], ["task"], ["sid"], 60).where("block = '1'").first()
    means = [np.mean([np.mean([{r[3]: r[6] for r in rows if r[1:3] == (t, "1")}[k] for n in (4, m) for i in range(1, n + 1) for k in [int(hashlib.md5(f"42|m|{t}|{b}|{i}".encode()).hexdigest()[:8], 16) % n]]) for t, m in (("s", 7), ("t", 9))]) for b in range(1, 61)]
    assert (both["ci95_iou_low"], both["ci95_iou_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)


def test_groups_of_few_bytes_are_not_joined_to_one_task(spark):
    rows = spark.range(200).selectExpr("concat('m', id % 40) AS model", "'t' AS task", "'0' AS block", "id AS sid", *(f"id / 30 AS {m}" for m in bootstrap.CI_METRICS))
    out = bootstrap.draws_sql_form(rows, ["model", "task", "block"], [], ["sid"], 5)
    assert out.count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "REPARTITION_BY_NUM" in dealt and "ENSURE_REQUIREMENTS" not in dealt[: dealt.index("REPARTITION_BY_NUM")]
