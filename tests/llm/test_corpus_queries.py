"""The corpus queries that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from stratapanel.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[k]) for k in order) for r in want.fetchall())
