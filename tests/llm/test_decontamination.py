from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from plain import hits_brute

from pixelloom.llm import decontamination as d


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (30, 2), (200, 3), (300, 50)):
        text = np.r_[rng.integers(1, k, n), 0]
        assert d.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_search_and_locate():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 5, 500), 0]
    index = d.FMIndex(text, 5)
    for length in (1, 2, 5, 9):
        phrases = np.array([text[a : a + length] for a in (0, 17, 300, 491)] + [[1] * length])
        low, high = index.search(phrases, np.full(5, length))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(501 - length) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_scan_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 13, 14, 30])))) for i in range(25)] + [(99, None), (None, "W1 w2, w3!"), (7, "w4 w4 w4")]
    docs = []
    for i in range(120):
        words = [rng.choice([*vocabulary, f"rare{rng.random()}"]) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            words[5:5] = (items[rng.randrange(25)][1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", " - "]).join(words)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    got = d.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard_words=500)
    got = d.with_digest(got).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        n, hit, found, bad = hits_brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (n, hit, found, bad)
        assert r["n_items"] == len(found) and r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() == d.digest(found)
        assert sum(b - a for a, b in r["spans"]) == hit


@pytest.mark.parametrize("block", [10, 300])
def test_blocks_of_phrases_agree(spark, monkeypatch, block):
    items = [(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(6)]
    docs = [(i, "some words before " + items[i % 6][1] + " and after") for i in range(10)]
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = d.scan(spark.createDataFrame(docs, "doc_id long, text string"), b).orderBy("doc_id").collect()
    real = d.blocks_of
    monkeypatch.setattr(d, "blocks_of", lambda *a, **k: real(*a, block_bytes=block))
    assert d.scan(spark.createDataFrame(docs, "doc_id long, text string"), b).orderBy("doc_id").collect() == whole


def test_awkward_rows_and_columns(docs, none, spark):
    b = spark.createDataFrame([(1, "the cat sat on the mat while the dog ran round the old house"), (2, None)], "item_id long, text string")
    got = d.scan(docs, b).collect()
    assert len(got) == docs.count() and {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 3, 11}
    assert d.scan(none, b).count() == 0
    assert d.scan(docs, b.where("false")).where("n_hit > 0").count() == 0


def test_names_that_differ_in_case_only(docs, spark):
    """A column named like an output, in whatever case, is replaced by it."""
    b = spark.createDataFrame([(1, "the cat sat on the mat while the dog ran round the old house")], "item_id long, text string")
    d2 = docs.select("doc_id", "text", docs.n_words.alias("N_WORDS"))
    got = d.scan(d2, b)
    assert [c.lower() for c in got.columns].count("n_words") == 1 and got.where("contaminated").count() == 5
