from __future__ import annotations

import math

import pytest

from pixelloom.llm import queries as q


def canonical(rows, columns):
    """Rows as sorted tuples of text, floats rounded, so two engines compare."""
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__module__ in ("numpy", "decimal"):
            return repr(round(float(v), 9) + 0.0)
        return str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    got = q.queries()[name](spark, sf_dir)
    cur = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = [dict(zip(columns, r)) for r in cur.fetchall()]
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical(want, columns)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, len(q.queries()) + 1))
