"""Nearest examples and votes against dense arithmetic, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import toxicity
from pixelloom.llm.common import held_out


def _index(seed, n=700, terms=60):
    rng = np.random.default_rng(seed)
    vectors = []
    for k in rng.integers(0, 6, n):
        t = np.sort(rng.choice(terms, k, replace=False)).astype(np.int64)
        vectors.append((t, rng.integers(1, 5, k)))
    return toxicity.Index(vectors, rng.integers(0, 2, n).astype(float), np.ones(n), list(range(n)))


def _dense(index, vector):
    out = np.zeros(len(index.vocabulary))
    out[vector[0]] = vector[1]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_is_exact(seed):
    index = _index(seed)
    vectors = index.vectors
    whole = np.array([_dense(index, v) for v in vectors])
    for q in range(0, 700, 7):
        dense = whole @ whole[q]
        got = index.nearest(vectors[q], 10)
        assert np.allclose([s for s, _ in got], np.sort(dense[dense > 0])[::-1][:10]) and all(dense[k] == pytest.approx(s) for s, k in got)


def test_cosines_and_votes_of_real_documents(spark):
    """Plain cosines over all terms, made from the counts alone, give the same neighbours, votes and scores."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, rates = toxicity.examples(docs, labels, doc_id="doc_id", text="text", label="toxic")
    index = toxicity.fit(docs, labels)
    train = [(r["doc_id"], dict(zip(*(x.tolist() for x in toxicity.Terms()(r["text"]))))) for r in rows.collect()]
    label = {r["doc_id"]: r["y"] for r in rows.collect()}
    n, ones = len(train), sum(label.values())
    assert rates == {0: 1.0, 1: 1.0} and n == len(label)
    with_term, with_one = {}, {}
    for i, v in train:
        for t in v:
            with_term[t] = with_term.get(t, 0) + 1
            with_one[t] = with_one.get(t, 0) + label[i]
    logit = lambda p: math.log(p / (1 - p))
    weight = {t: (math.log((1 + n) / (1 + d)) + 1) * (abs(logit((with_one[t] + 5 * ones / n) / (d + 5)) - logit(ones / n)) + 0.02) ** 2 for t, d in with_term.items()}

    def unit(v):
        w = {t: (1 + math.log(c)) * weight[t] for t, c in v.items() if t in weight}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    units = [(i, unit(v)) for i, v in train]
    some = docs.where("doc_id % 50 = 0 and length(text) > 0").collect()
    got = {r["doc_id"]: r for r in toxicity.score(docs, index, held_out(F.col("doc_id"))).collect()}
    for r in some:
        q = unit(dict(zip(*(x.tolist() for x in toxicity.Terms()(r["text"])))))
        cosines = sorted(((sum(x * v.get(t, 0.0) for t, x in q.items()), i) for i, v in units), reverse=True)
        best = [c for c in cosines if c[0] > 0][: toxicity.NEIGHBOURS]
        near = index.nearest(index.unit(*toxicity.Terms(index.vocabulary)(r["text"])))
        assert np.allclose([s for s, _ in near], [s for s, _ in best])
        if len({round(s, 9) for s, _ in cosines[: toxicity.NEIGHBOURS + 1]}) == toxicity.NEIGHBOURS + 1:  # no tie
            w = [s / (1.05 - min(s, 1)) for s, _ in best]
            vote = sum(x * label[i] for x, (_, i) in zip(w, best)) / sum(w)
            assert index.vote(near) == pytest.approx(vote, rel=1e-5) and got[r["doc_id"]]["score"] == pytest.approx(index.probability(vote), rel=1e-4)
            assert got[r["doc_id"]]["evidence"] == [i for _, i in best[:5]]


def test_scores_are_calibrated_probabilities():
    index = _index(3)
    index.calibrate(np.array([index.vote(index.nearest(v, but=k)) for k, v in enumerate(index.vectors)]))
    y = index.steps[1]
    assert (np.diff(y) >= -1e-12).all() and y.min() >= 0 and y.max() <= 1
    none = np.zeros(0, np.int64)
    assert 0 <= index.score(none, none)[0] <= 1 and 0 <= index.score(np.array([1, 5]), np.array([2, 1]))[0] <= 1


def test_toxic_rows_are_found_and_all_have_evidence(spark):
    from pixelloom.llm.queries import op5_toxicity_neighbours

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op5_toxicity_neighbours(spark, sf).cache()
    j = labels.join(got, "doc_id").where("held_out")
    toxic, clean = j.where("toxic = 1"), j.where("toxic = 0")
    print("toxic found", toxic.where("predicted = 1").count() / toxic.count(), "clean flagged", clean.where("predicted = 1").count() / clean.count())
    assert toxic.where("predicted = 1").count() >= 0.85 * toxic.count()
    assert clean.where("predicted = 1").count() <= 0.01 * clean.count()
    texts = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").rlike(r"\p{L}"))
    lettered = texts.join(got, "doc_id").where("held_out")
    assert lettered.where("size(evidence) > 0").count() >= 0.95 * lettered.count()


def test_toxicity_of_awkward_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (3, 0, 1), (3, 0, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    held = held_out(F.col("doc_id"))
    got = toxicity.score(docs, toxicity.fit(docs, labels), held).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false")), held).collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, labels), held).count() == 0


def test_words_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x110000)))
    assert toxicity.words_of(every) == toxicity._WORDS.findall(every.lower())
    mixed = "a".join(map(chr, range(0x3000))) + " ".join(map(chr, range(0x1D000, 0x20000)))
    assert toxicity.words_of(mixed) == toxicity._WORDS.findall(mixed.lower())
    assert toxicity.words_of(None) == toxicity.words_of("") == toxicity.words_of(" 12_3 \x00") == []


@pytest.mark.parametrize("known", [False, True])
def test_terms_are_made_for_many_texts_at_once(known, monkeypatch):
    texts = [f"Wort{'abcdefghij'[k % 10] * (k % 7)} und {'xyz'[k % 3] * (k // 9)}, und_\u00df\u0130 x\u00b2 \U0001d41a9\u4e2d" for k in range(300)] + [None, "", "12 _"]

    def plain(text):
        words = Counter(toxicity._WORDS.findall((text or "").lower()))
        out = Counter()
        for w, c in words.items():
            out[crc32(w.encode())] += c
            if len(w) > 5:
                out[crc32(f"{w[:5]}~".encode())] += c
        return out

    vocabulary = np.unique([t for text in texts[:40] for t in plain(text)]) if known else None
    want = [sorted(plain(t).items()) for t in texts]
    if known:
        place = {t: k for k, t in enumerate(vocabulary.tolist())}
        want = [[(place[t], c) for t, c in w if t in place] for w in want]
    read = lambda got: [list(zip(t.tolist(), c.tolist())) for t, c in got]
    terms, learnt = toxicity.Terms(vocabulary), []
    learn = terms.learn
    terms.learn = lambda words: (learnt.append(len(words)), learn(words))
    assert read(terms.many(texts)) == want and len(learnt) == 1
    assert read(map(terms, texts)) == want and len(learnt) == 1  # all words are known by then
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 7)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 10)
    assert read(toxicity.Terms(vocabulary).many(iter(texts))) == want
    assert list(toxicity.Terms(vocabulary).many([])) == []


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nearest_is_exact_for_rare_and_common_terms(seed):
    rng = np.random.default_rng(seed)
    vectors = []
    for k in rng.integers(0, 40, 900):
        t = np.unique(np.minimum(rng.zipf(1.3, k), 2000)).astype(np.int64)
        vectors.append((t, rng.integers(1, 5, len(t))))
    index = toxicity.Index(vectors, rng.integers(0, 2, 900).astype(float), np.ones(900), list(range(900)))
    assert 0 < len(index.maxima) < len(index.vocabulary)  # terms of both kinds
    vectors = index.vectors
    whole = np.array([_dense(index, v) for v in vectors])
    for but in range(0, 900, 9):
        dense = whole @ whole[but]
        dense[but] = 0.0
        got = index.nearest(vectors[but], 11, but=but)
        assert np.allclose([s for s, _ in got], np.sort(dense[dense > 0])[::-1][:11]) and all(k != but and dense[k] == pytest.approx(s) for s, k in got)


def test_examples_without_terms_are_nobodys_neighbours():
    """Such an example stands in a block that stays open, since fewer than k examples share a term with the query."""
    one, none = np.ones(1, np.int64), np.zeros(0, np.int64)
    vectors = [(none, none), (0 * one, one), (one, one), (none, none)]
    index = toxicity.Index(vectors, np.array([1.0, 0.0, 1.0, 1.0]), np.ones(4), [7, 8, 9, 10])
    query = index.unit(np.array([0, 1]), np.array([1, 1]))
    assert sorted(index.ids[k] for _, k in index.nearest(query)) == [8, 9]
    assert index.nearest((none, np.zeros(0))) == []
