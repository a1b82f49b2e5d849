"""Each registered query against its SQL at the smallest scale, and the contract of the entry module."""

import importlib
import math
import os
from collections import Counter

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def plain(v):
    if type(v).__name__ == 'Decimal':
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def library():
    from sweepframe import catalog

    return catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in library()[0] if n in library()[1]))
def test_against_sql(spark, db, name):
    df = library()[0][name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(plain(tuple(r[c] for c in columns)) for r in df.collect())
    want = db.sql(library()[1][name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
