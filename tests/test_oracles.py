"""Every registered query with SQL against DuckDB on the smallest tables."""

import collections
import os

import duckdb
import pytest

from sievework import catalog


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).count() > 0, name


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
