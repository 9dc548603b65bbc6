"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans import registry

SLOW = {"leakage_canary"}


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(v) for v in r) for r in df.select(*cols).collect())
    res = duck.execute(f"select * from ({registry.oracle_sql()[name]})")
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["day", "equity", "peak", "drawdown"]
    assert set(e.oracle_sql()) <= set(e.queries())
