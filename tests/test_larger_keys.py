"""Queries against their SQL on keys with more digits than the smallest tables have, and on ties at the edge of an outline."""

from __future__ import annotations

import pytest
from compare import canonical

from pixelloom import catalog

duckdb = pytest.importorskip("duckdb")


def equals_its_sql(name, spark, sf_dir, tmp_path, table, change):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({change}) FROM '{sf_dir}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = [dict(zip(columns, r)) for r in cur.fetchall()]
    assert canonical([r.asDict() for r in catalog.queries()[name](spark, str(tmp_path)).collect()], columns) == canonical(want, columns)


def test_derive_preservation(spark, sf_dir, tmp_path):
    equals_its_sql("derive_preservation", spark, sf_dir, tmp_path, "supplier", "s_suppkey * 1003 AS s_suppkey")


@pytest.mark.parametrize("name", ["eval_job_plan", "join_left_outputs"])
def test_output_names(name, spark, sf_dir, tmp_path):
    equals_its_sql(name, spark, sf_dir, tmp_path, "supplier", "s_suppkey * 10007 AS s_suppkey")


def test_sidecar_path_rule(spark, sf_dir, tmp_path):
    equals_its_sql("sidecar_path_rule", spark, sf_dir, tmp_path, "part", "p_partkey * 10007 AS p_partkey")
