"""Registered queries of the panel engine against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratapanel.plans.registry import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value).split(" 00:00:00")[0]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert {"alpha_fwd_1m", "z_beta_mkt", "mom_12_1"} <= set(entry.entry(spark).columns)
