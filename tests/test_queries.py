"""Every registered query against its SQL on the smallest tables, where they are there."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{ROOT}/*.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def settled(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(settled, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted((tuple(settled(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(settled(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns
