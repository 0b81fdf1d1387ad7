"""Language identification: brute force on small cases, held-out accuracy on the tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import language_id
from pixelloom.llm.common import held_out


# -- language --------------------------------------------------------------------------------------

def test_trigrams_split_at_non_letters():
    a, b = language_id.trigrams("Ab, cd"), language_id.trigrams("ab\n--cd!")
    assert len(a) == 4 and sorted(a) == sorted(b)
    assert len(language_id.trigrams("12 34 !")) == 0 == len(language_id.trigrams(None))


def _model():
    counts = np.zeros((language_id.BUCKETS, 2))
    for k, text in enumerate(("the cat sat on the mat and the dog ran", "der hund lief und die katze schlief nicht")):
        np.add.at(counts[:, k], language_id.trigrams(text), 1)
    return language_id.Mixture(["en", "de"], counts)


def test_em_does_not_lose_likelihood():
    m = _model()
    g, n = np.unique(language_id.trigrams("the cat und die katze"), return_counts=True)
    p, share = m.p[g], np.full(2, 0.5)
    before = float(n @ np.log(p @ share))
    for _ in range(5):
        share, value = m.em(p, n.astype(float), share)
        assert value >= before - 1e-9 and share.sum() == pytest.approx(1)
        before = value


def test_mixture_finds_both_languages():
    m = _model()
    assert set(m.infer("the cat sat on the mat")) == {"en"} and set(m.infer("der hund lief und die katze")) == {"de"}
    both = m.infer("the cat sat on the mat and the dog ran " * 4 + "der hund lief und die katze schlief nicht " * 4)
    assert set(both) == {"en", "de"} and all(0.3 < v < 0.7 for v in both.values())
    assert m.infer("123") == {}


def test_language_of_held_out_rows(spark, sf_dir):
    from pixelloom.llm.queries import op4_language_mixture

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op4_language_mixture(spark, sf_dir)
    j = docs.join(got, "doc_id").where("held_out and lang is not null")
    good = j.where("lang = lang_pred").count() / j.count()
    assert good > 0.95 and got.where("score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def test_language_of_awkward_rows(docs, none, spark):
    held = held_out(F.col("doc_id"))
    model = language_id.fit(docs, "lang", "text", ~held)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model, held).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6))
    assert language_id.predict(docs, language_id.fit(none, "lang", "text", ~held), held).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, model, held).count() == 0


def test_a_language_of_one_repeated_text_is_learned(spark):
    """More rows than are drawn, all of one text: drawn by id, so the language isn't lost."""
    en = [(i, "en", f"the cat number {i} sat on the mat and the dog ran") for i in range(300)]
    for turn, text in enumerate(("der hund lief und die katze schlief nicht", "guten morgen liebe sorgen", "wo ist der bahnhof", "ich habe keine zeit")):
        rows = en + [(1_000 + i, "de", text) for i in range(6_000)]
        d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        model = language_id.fit(d, "lang", "text", F.lit(True))
        assert model.languages == ["de", "en"] and model.infer(text).keys() == {"de"}, turn


def test_inference_against_a_plain_version():
    """Proportions and chosen languages by loops over single trigrams."""
    m = _model()
    for text in ("the cat und die katze sat und schlief", "der hund " * 9 + "the dog " * 7, "mat", "katze dog"):
        grams = language_id.trigrams(text).tolist()

        def em(languages):
            share = [1 / len(languages)] * len(languages)
            for _ in range(language_id.ITERATIONS):
                new = [0.0] * len(languages)
                for g in grams:
                    total = sum(s * m.p[g, k] for s, k in zip(share, languages))
                    for j, k in enumerate(languages):
                        new[j] += share[j] * m.p[g, k] / total / len(grams)
                share = new
            return share, sum(math.log(sum(s * m.p[g, k] for s, k in zip(share, languages))) for g in grams)

        alone = [em([k])[1] for k in range(2)]
        first = alone.index(max(alone))
        all_, _ = em([0, 1])
        other = 1 - first
        share, value = em([first, other])
        if all_[other] >= language_id.LEAST_SHARE and value - alone[first] > language_id.PENALTY * math.log(len(grams) + 1):
            want = {m.languages[first]: share[0], m.languages[other]: share[1]}
        else:
            want = {m.languages[first]: 1.0}
        assert m.infer(text) == pytest.approx(want)
