from __future__ import annotations

import random
import time

import numpy as np
import pytest
from plain import near_brute, shingles

from pixelloom.llm import near_dup as nd


def corpus(seed, n=260, size=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.randint(3, size))]
        if rng.random() < 0.3:
            base[:20] = [f"shared{i}" for i in range(20)]
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    return rows + [(9001, None), (9002, ""), (9003, "Solo"), (9004, "sOLO"), (None, "no id at all"), (None, "No id AT all"), (5, "another text with an id used twice")]


@pytest.mark.parametrize(("seed", "shingle", "percent"), [(1, 3, 85), (2, 5, 80), (3, 1, 60)])
def test_components_match_brute_force(spark, seed, shingle, percent):
    rows = corpus(seed)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=shingle, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_brute(rows, shingle, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_large_nodes_go_down_levels(spark, monkeypatch):
    """Small limits, so levels of rows, levels in a task, chunks, bands and strays all have work."""
    monkeypatch.setattr(nd, "CHUNK", 3)
    monkeypatch.setattr(nd, "PIVOTS", 1)
    monkeypatch.setattr(nd, "LOCAL_EDGES", 5)
    rows = corpus(7, 200, 60)
    rows += [(10_000 + i, " ".join([f"shared{j}" for j in range(40)] + [f"tail{i % 9}", f"end{i}"])) for i in range(60)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, task=12, leaf=3).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_brute(rows, 3, 85)


def test_classes_are_dealt_to_nodes_once(spark, monkeypatch):
    """Large nodes are counted, left out, judged and taken down; none of that makes the nodes' rows again."""
    plans, stored = [], nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), stored(df, name))[1])
    rows = [(i, " ".join([f"shared{j}" for j in range(40)] + [f"tail{i % 9}", f"end{i}"])) for i in range(120)]
    assert nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), task=12, leaf=3).count() == 120
    assert any(name == "near-level0-below" for name, _ in plans), "some nodes are large"
    assert sum(plan.count("Generate explode(array(k") for _, plan in plans) == 1


def test_linked_joins_what_brute_force_joins():
    rng = random.Random(3)
    for trial in range(30):
        base = [np.array(rng.sample(range(400), 60), np.uint64) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 40)):
            s = set(rng.choice(base).tolist())
            s = [x for x in s if rng.random() > 0.06] + [rng.randrange(400, 2_000) for _ in range(rng.randint(0, 5))]
            sets.append(np.unique(np.array(s, np.uint64)))
        m = len(sets)
        side = np.array([rng.random() < 0.5 for _ in range(m)]) if trial % 2 else None
        pairs = [(i, j) for i in range(m) for j in range(i) if side is None or side[i] or side[j]]
        both = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
        want = [p for p in pairs if 100 * both[p] >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - both[p])]
        got = nd.linked(sets, np.arange(m), 80, side)
        assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
        at = lambda e: nd.joined(m, np.array([p[0] for p in e], int), np.array([p[1] for p in e], int)).tolist()
        assert at(got) == at(want)


def test_recall_is_as_stated():
    assert nd.recall_at_threshold(0.8) > 0.999 and nd.recall_at_threshold(0.85, depth=2) > 0.999


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101)]
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and got[101] == got[100] != got[1]


def test_deduplicated(docs, none):
    got = nd.deduplicated(docs).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    assert docs.columns == list(got[0].asDict())
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 11 not in ids, "copies, a near copy, and the text in capitals go"
    assert {4, 5, 6, 9, 10, 12, 13, 14} <= set(ids) and ids.count(None) == 2 and 7 in ids and 8 not in ids
    assert nd.deduplicated(none).count() == 0


def test_recall_of_exact_links_on_many_rows(spark):
    """50,000 texts, every fourth with an edited copy; passages that thousands share make root nodes go down two levels and more."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5_000)]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(4)]
    rows, pairs = [], []
    while len(rows) < 50_000:
        base = [rng.choice(words) for _ in range(40)]
        if rng.random() < 0.5:
            base[:0] = rng.choice(passages)
        rows.append((len(rows), " ".join(base)))
        if len(rows) % 4 == 0:
            copy = list(base)
            for _ in range(1 + (len(base) > 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            pairs.append((len(rows) - 1, len(rows)))
            rows.append((len(rows), " ".join(copy)))
    texts = dict(rows)
    sets = {i: shingles(texts[i], 3) for p in pairs for i in p}
    linked = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(linked) > 5_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, shingle=3, percent=85, task=8_000, leaf=16).collect()}
    recall = sum(root[i] == root[j] for i, j in linked) / len(linked)
    print(f"recall of {len(linked)} exact links: {recall:.5f}")
    assert recall >= 0.999


@pytest.mark.parametrize("id_", [None, 7])
def test_rows_without_an_id_or_of_one_id(spark, id_):
    """3,000 near pairs whose rows share an id, or have none: as fast as with ids, and one row a pair stays."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3_000)]
    pairs = []
    for _ in range(3_000):
        base = [rng.choice(words) for _ in range(60)]
        copy = list(base)
        copy[rng.randrange(60)] = "other"
        pairs.append((" ".join(base), " ".join(copy)))
    rows = [(id_, t) for p in pairs for t in p] + [(id_, pairs[0][0])] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    kept = [r["text"] for r in nd.deduplicated(docs).collect()]
    assert time.time() - began < 90
    assert len(kept) == len(set(kept)) == 3_000 and all((a in kept_set) != (b in kept_set) for kept_set in [set(kept)] for a, b in pairs)
    found = nd.near_duplicates(docs)
    assert found.count() == 6_050 and found.select("component_id").distinct().collect()[0][0] == id_
