"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if math.isnan(x) else round(float(x), 4) + 0.0
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    res = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_all_names_have_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
