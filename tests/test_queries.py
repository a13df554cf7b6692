"""Every registered query that has SQL gives the same rows as DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    want = Counter(tuple(map(plain, r)) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    assert {r.decision for r in entry.entry(spark).collect()} <= {"approve", "flag", "needs_review"}
