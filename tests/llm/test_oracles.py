"""Registered corpus queries against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quartzline.llm import oracles, queries

KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double"}


def test_names():
    assert set(oracles.SQL) == set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.sql(oracles.SQL[name])
        columns, kinds = want.columns, {c: KINDS[str(t)] for c, t in zip(want.columns, want.types, strict=True)}
        rows = sorted(want.fetchall())
    got = queries.queries()[name](spark, sf)
    assert dict(got.dtypes) == kinds
    assert sorted(tuple(r) for r in got.select(columns).collect()) == rows
