"""Every library query against its SQL in another engine, on the small tables."""

import math
import os

import duckdb
import pytest
from oddlines.oracle import SQL
from oddlines.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in found.fetchall())
    assert got == want


def test_whitened_features_lie_in_the_unit_interval(spark):
    rows = QUERIES["whitening"](spark, SF).collect()
    assert len(rows) == 5 and all(0 <= r["low"] <= r["mean"] <= r["high"] <= 1 for r in rows)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
