"""Registry of queries: a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is BIGINT in every SQL engine."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:k] + f"(count(*) FILTER (WHERE {plain_counts(sql[k + 9 : end - 1])}))"
        at = end
    return out + sql[at:]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = plain_counts(sql)
        return f

    return add
