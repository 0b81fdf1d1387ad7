from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pixelloom.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<double>, cluster string, d int, low string, label int"


def brute(rows, dims, k, rounds, seed=2):
    """The contract in plain Python: all distances, exact integers."""
    kept = []
    for i, x in rows:
        if x is None or len(x) != dims or any(e is None or not math.isfinite(e) for e in x):
            continue
        v = [math.floor(256 * e) for e in x]
        if all(abs(e) < cl.MAX_COMPONENT for e in v):
            kept.append((i, v))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    if not centres:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            of = [v for (_, v), c in zip(kept, own) if c == j]
            if of:
                centres[j] = [sum(col) // len(of) for col in zip(*of)]
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i, j, d, sum(j == y for _, _, y in found), sum(x for _, x, y in found if y == j), sum(x for _, x, _ in found), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, x, "c", 1, "l", 2) for i, x in rows], SCHEMA).repartition(3)
    out = cl.cluster_vectors(df, **how)
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("scale,width", [(2, 4), (3, 8), (40, 8), (3000, 3)])
def test_bounds_never_change_an_assignment(scale, width):
    """Coarse grids give many ties, and empty and equal centroids; each round is held against all distances."""
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale, (2500, width)).astype(np.int32)
    x[1000:1400] = x[5]
    centres, b = x[:12].astype(np.int64).copy(), None
    centres[3] = centres[4]
    done = []
    for n in range(7):
        d = ((x[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(-1)
        own = d.argmin(1)
        b = cl.first_round(x, centres) if b is None else cl.next_round(x, centres, moved, b, exact=n % 2 == 0)  # noqa: F821
        assert (b.cluster == own).all()
        exact = b.d >= 0
        assert (b.d[exact] == d.min(1)[exact]).all() and (exact.all() or n % 2)
        root = np.sqrt(d.astype(np.float64))
        assert (b.low <= root).all() and (b.up >= root[np.arange(len(x)), own]).all()
        done.append(b.computed / d.size)
        new = np.array([x[own == c].sum(0, dtype=np.int64) // (own == c).sum() if (own == c).any() else centres[c] for c in range(12)])
        moved = cl._up(np.sqrt(((new - centres) ** 2).sum(1).astype(np.float64))).astype(np.float64)
        centres = new
    assert done[0] < 1 and done[5] < 0.7, "bounds have to save distances"


def test_equals_plain_arithmetic_with_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(e) for e in rng.normal(0, 0.3, 5)]) for i in range(120)]
    same = [(200 + i, [0.25, -0.5, 0.0, 1.0, -0.001953125]) for i in range(60)]
    odd = [
        (300, None), (301, []), (302, [0.1] * 4), (303, [0.1] * 6), (304, [0.1, None, 0.1, 0.1, 0.1]), (305, [float("nan")] * 5), (306, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
        (307, [1e300] * 5), (308, [-1e12, 0.0, 0.0, 0.0, 0.0]), (309, [500_000.0] * 5), (None, [0.5] * 5), (None, [0.5, 0.5, 0.5, 0.5, -0.5]), (5, [9.0] * 5), (5, [9.0] * 5),
    ]
    rows = good + same + odd
    for k, rounds in ((7, 4), (40, 5), (1, 2)):
        assert run(spark, rows, dims=5, k=k, rounds=rounds) == brute(rows, 5, k, rounds)


def test_few_none_and_equal_vectors(spark):
    few = [(i, [float(i), 0.0]) for i in range(3)]
    assert run(spark, few, dims=2, k=40) == brute(few, 2, 40, 5)
    equal = [(i, [0.5, 0.5]) for i in range(50)]
    found = run(spark, equal, dims=2, k=10)
    assert found == brute(equal, 2, 10, 5) and {r[1] for r in found} == {0}
    assert run(spark, [(1, None), (2, [1.0])], dims=2) == []
    assert cl.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_floats_are_taken_as_doubles(spark):
    df = spark.createDataFrame([(i, [0.1 * i, -0.3]) for i in range(30)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in cl.cluster_vectors(df, dims=2, k=4).select("vec_id", "cluster", "distance").collect())
    assert got == sorted((r[0], r[1], r[2]) for r in brute([(i, [float(np.float32(0.1 * i)), float(np.float32(-0.3))]) for i in range(30)], 2, 4, 5))
