"""Masked pseudo-likelihood: gradients, plain recomputation, held-out likelihood, shares of words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import lm_score as lm


def lexicon_of(texts):
    counts = Counter(w for t in texts for w in lm.words_of(t))
    totals = Counter()
    for w, n in counts.items():
        totals[lm.group_of(w)] += n
    return lm.Lexicon(sorted(counts.items(), key=lambda x: (-x[1], x[0])), totals), counts


def coded(lex, text):
    return lex.code_of[lm.Coder(lex).numbers(lm.words_of(text))]


def told(lex):
    """Codes of the words that are told apart."""
    return {w: int(lex.code_of[k]) for w, k in lex.number.items() if lex.part_of[k] == 0}


def corpus(n=1_500):
    return [" ".join(f"w{i}e{i % 7}" for i in np.random.default_rng(k).zipf(1.3, 60) if i < 4_000) for k in range(n // 60)]


def test_gradient_step_lowers_the_loss():
    texts = ["a b c d e f g h " * 40] * 3 + corpus()
    lex, _ = lexicon_of(texts)
    net, codes = lm.Network(lex), coded(lex, texts[0])
    around = lm.windows(codes)
    first = net.logs(around, codes).mean()
    for _ in range(200):
        net.train(around, codes)
    assert net.logs(around, codes).mean() > 0.5 * first


def test_gradient_is_right():
    texts = corpus(3_000)
    lex, _ = lexicon_of(texts)
    codes = np.concatenate([coded(lex, t) for t in texts])[:150]
    around = lm.windows(codes)
    assert (codes // lm.WIDTH >= lm.ALONE).any()

    def loss(v):
        m = lm.Network(lex)
        for x in m.NAMES:
            setattr(m, x, getattr(m, x).astype(np.float64))
        m.load(v)
        return -m.logs(around, codes).sum()

    net = lm.Network(lex)
    start = net.vector().astype(np.float64)
    net.train(around, codes, step=1e-3 * math.sqrt(len(codes)))
    move = (start - net.vector()) / 1e-3
    for k in np.argsort(-np.abs(move))[:: 40][:12]:
        step = np.zeros_like(start)
        step[k] = 1e-3
        assert move[k] == pytest.approx((loss(start + step) - loss(start - step)) / 2e-3, rel=0.05, abs=0.02)


def test_shares_sum_to_one():
    texts = corpus(6_000)
    lex, counts = lexicon_of(texts)
    assert lex.root_share.sum() == pytest.approx(1) and np.allclose(lex.node_share.sum(1), 1)
    own = told(lex)
    assert len(set(own.values())) == len(own) > lm.ALONE and len(set(lm.CONTEXT[list(own.values())].tolist())) == len(own)
    for g in range(lm.GROUPS):
        rest = [n for w, n in counts.items() if w not in own and lm.group_of(w) == g]
        assert math.exp(lex.one[g]) * (sum(rest) + 1) == pytest.approx(1)


def test_frequent_words_by_a_histogram(spark):
    rows = [(f"w{i}".encode(), 1 + i * i) for i in range(500)] + [(f"x{i}".encode(), 1) for i in range(5_000)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    got = lm.frequent(counts, 300)
    assert 200 < len(got) <= 300 and got == sorted(rows, key=lambda x: (-x[1], x[0]))[: len(got)]
    assert lm.frequent(counts.where("false"), 300) == []


def test_scores_against_a_plain_loop(spark, sf_dir):
    """Every word of real documents, one by one: hidden layer, root, group, share of a rest word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lex, net = lm.fit(docs)
    got = {r["doc_id"]: r for r in lm.score(docs, (lex, net)).collect()}
    assert got == {r["doc_id"]: r for r in lm.fit_and_score(docs).collect()}
    counts, code = {bytes(r["word"]): r["n"] for r in lex.counts.collect()}, told(lex)
    rest = Counter()
    for w, n in counts.items():
        if w not in code:
            rest[lm.group_of(w)] += n

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for r in docs.where("doc_id % 9 = 0").collect():
        words = lm.words_of(r["text"])[:10_000]
        if len(words) != len(lm.words_of(r["text"])):
            continue
        own = [code.get(w, (lm.REST + lm.group_of(w)) * lm.WIDTH) for w in words]
        branch = [c // lm.WIDTH for c in own]

        def at(i):
            if not 0 <= i < len(words):
                return lm.ALONE + lm.GROUPS * lm.WIDTH + lm.GROUPS
            if branch[i] < lm.ALONE:
                return branch[i]
            return lm.ALONE + own[i] - lm.ALONE * lm.WIDTH if branch[i] < lm.REST else lm.ALONE + lm.GROUPS * lm.WIDTH + branch[i] - lm.REST

        total = 0.0
        for i, w in enumerate(words):
            h = np.tanh(net.b.astype(float) + net.E[0][at(i - 2)] + net.E[1][at(i - 1)] + net.E[2][at(i + 1)] + net.E[3][at(i + 2)])
            total += math.log(softmax(h @ net.U + net.c)[branch[i]])
            if lm.ALONE <= branch[i] < lm.REST:
                g = branch[i] - lm.ALONE
                total += math.log(softmax(h @ net.W[g] + net.d[g])[own[i] % lm.WIDTH])
            if w not in code:
                total += math.log(counts[w] / (rest[lm.group_of(w)] + 1))
        assert got[r["doc_id"]]["n_tokens"] == len(words)
        assert got[r["doc_id"]]["sum_logprob"] == pytest.approx(total, rel=1e-4, abs=2e-3)


def test_held_out_likelihood_beats_the_model_without_context(spark):
    """Trained on two thirds of real documents, the context tells words of the others better than shares alone do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lex, net = lm.fit(docs.where("doc_id % 3 <> 0"))
    flat = lm.Network(lex)
    flat.U[:], flat.W[:] = 0, 0
    held = docs.where("doc_id % 3 = 0")
    mean = lambda m: lm.score(held, (lex, m)).agg(F.sum("sum_logprob") / F.sum("n_tokens")).first()[0]
    trained, without = mean(net), mean(flat)
    print(f"held-out log-probability a word: {trained:.4f}, without context {without:.4f}")
    assert trained > without + 0.2 and trained > -12.2


def test_model_learns_and_scores_whole_texts(docs, none, spark):
    sentence = "the quick brown fox jumps over the lazy dog and then it sleeps . "
    rows = [(i, sentence * (i % 4 + 1)) for i in range(300)] + [(900, None), (901, ""), (None, "odd words")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.fit(d, rounds=3)
    got = {r["doc_id"]: r for r in lm.score(d, model).collect()}
    assert got[900]["n_tokens"] == 0 and got[900]["sum_logprob"] == 0 and got[900]["mean_logprob"] is None
    assert got[3]["n_tokens"] == len(lm.words_of(rows[3][1]))
    assert got[None]["mean_logprob"] < got[3]["mean_logprob"]
    again = {r["doc_id"]: r["sum_logprob"] for r in lm.score(d, model).collect()}
    assert again == {k: r["sum_logprob"] for k, r in got.items()}
    assert lm.fit_and_score(docs).count() == docs.count() and lm.score(none, lm.fit(none)).count() == 0


def test_every_counted_word_has_its_own_share(spark, monkeypatch):
    """Words past the ones that workers know by heart: more frequent is more likely, none is spelled."""
    monkeypatch.setattr(lm, "VOCABULARY", lm.ALONE)
    rows = [(i, " ".join(f"top{j}" for j in range(lm.ALONE))) for i in range(60)]
    rows += [(100 + i, "often_xyz") for i in range(50)] + [(200 + i, "seldom_xyz") for i in range(2)] + [(300, "a_xyz often_xyz often_xyz")]
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    asked = [(1, "often_xyz"), (2, "seldom_xyz"), (3, "unseen_xyz"), (4, "seldom_xyz seldom_xyz"), (5, None)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[1]["sum_logprob"] - got[2]["sum_logprob"] == pytest.approx(math.log(52 / 2), abs=2e-4)
    assert got[2]["sum_logprob"] - got[3]["sum_logprob"] == pytest.approx(math.log(2) - lm.SPELL * 10, abs=2e-4)
    assert got[4]["n_tokens"] == 2 and got[5]["n_tokens"] == 0 and got[5]["sum_logprob"] == 0 and got[5]["mean_logprob"] is None
