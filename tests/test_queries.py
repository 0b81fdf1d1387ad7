"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import canonical

from pixelloom import catalog
from pixelloom.plans import q_generate

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = [dict(zip(columns, r)) for r in cur.fetchall()]
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(name, spark, sf_dir, monkeypatch):
    """Generated pictures are an eighth as wide here; tests/test_scoring.py has full-size ones."""
    monkeypatch.setattr(q_generate, "SCALE", 0.125)
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
