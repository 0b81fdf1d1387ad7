"""Each stage against a plain version of its rule, on its own input."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest
from plain import hits_brute, near_brute, quality_kept

from pixelloom.llm import common, decontamination
from pixelloom.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "t-" + name.replace(" ", "")))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mixing", "token output"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(steps):
    rows = steps[0].select("doc_id", "text", "source").collect()
    want = quality_kept([(r["text"], r["source"]) for r in rows])
    assert set(texts(steps[1])) == {r["doc_id"] for r, kept in zip(rows, want) if kept}


def test_near_duplicates(steps):
    rows = list(texts(steps[1]).items())
    assert set(texts(steps[2])) == {i for i, _, c in near_brute(rows, 5, 80) if i == c}


def test_decontamination(steps, spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = texts(steps[3])
    for i, t in texts(steps[2]).items():
        words = set(decontamination.words_of(t))
        bad = hits_brute(t, [x for x in items if words & set(decontamination.words_of(x[1]))])[3]
        assert (i in kept) == (not bad)


def test_mixing_repeats_whole_documents(steps):
    whole = texts(steps[3])
    rows = steps[4].select("doc_id", "text").collect()
    assert all(whole[r["doc_id"]] == r["text"] for r in rows)
    assert max(sum(r["doc_id"] == i for r in rows) for i in whole) <= 3


def test_tokens(steps):
    got = sorted(steps[5].collect(), key=lambda r: r["start"])
    assert len(got) == steps[4].count()
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] > 0
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


@pytest.mark.parametrize("table", ["docs", "none"])
def test_awkward_rows(table, request, spark, sf_dir):
    d = request.getfixturevalue(table)
    for name, stage in cp.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() <= 3 * max(1, d.count()), name


def test_columns_that_operators_also_make_keep_their_values(docs, spark, sf_dir):
    out = docs
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
        assert {(r["n_words"], r["kept"], r["size"], r["key"], r["cid"]) for r in out.collect()} <= {(1, "x", "y", 2, "z")}


def test_run_keeps_its_last_table_only(spark, sf_dir, tmp_path, monkeypatch):
    """A stage's table is deleted once the next is stored; what is returned stays readable, and the given tables untouched."""
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    out = cp.run(spark, sf_dir)
    assert out.count() > 0 and [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.name.startswith("stage-")] == ["stage-token-output"]
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").count() > 0
