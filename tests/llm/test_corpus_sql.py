"""Corpus queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.llm import queries

DATA = os.environ.get("CORPUS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    res = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
