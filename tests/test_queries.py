"""Registered queries beside their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = [n for n in SQL if not n.startswith(("p4", "p6", "p7"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["person_id"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, D)
    got, names = rows(df.columns, df.collect())
    r = con.execute(SQL[name])
    want, wnames = rows([c[0] for c in r.description], r.fetchall())
    assert names == wnames and got == want
