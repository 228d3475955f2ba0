"""Every query that SQL can express, on the smallest tables, against DuckDB."""

import math
import os

import duckdb
import pytest
from barweave import catalog

SF = "/root/testdata/sf0.001"
#: Groups have two members at this size, so breadth and small folds are legitimately empty.
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
