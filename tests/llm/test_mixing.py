from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from pixelloom.llm import mixing


def filled(sizes):
    """Targets by the plain loop: share by weight, cap at three times the size, share the excess."""
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in capped]
        rest = left - sum(3 * sizes[s] for s in capped)
        total = sum(weight[s] for s in open_)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / total for s in sizes}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def corpus(seed, sources=9, n=400):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(sources)] + [None]
    return [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 5))), rng.choices(names, [8, *[1] * (len(names) - 1)])[0]) for i in range(n)] + [(n, None, "s1"), (n + 1, "", "zero"), (0, "x y", "s2"), (0, "x y", "s2"), (None, "no id", "s3")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-5)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, "the budget is met exactly but for ties"
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(d.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents(spark):
    rows = corpus(5)
    d = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, source string, size string")
    plan = {(r["doc_id"], r["source"]): (r["taken"], r["size"]) for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    times = Counter((r["doc_id"], r["source"]) for r in out.collect())
    for k, (taken, size) in plan.items():
        if size and k[0] not in (0, None):
            assert abs(times[k] - taken / size) < 1


def test_awkward_rows(docs, none):
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_only_empty_texts(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}
