"""Every registered query on the smallest test tables: runs, and equals its SQL oracle
(row count, column names, order-insensitive values) where one is given."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.plans import catalog
from ledgerline.session import TABLES

NAMES = sorted(catalog.QUERIES)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["segment", "field", "n"] and len(rows) > 0


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(catalog.QUERIES) - set(E.oracle_sql())
    assert missing == set(), missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _bag(rows, cols) == _bag(orows, ocols)
