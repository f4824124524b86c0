"""Every named query runs on the smallest tables; those with SQL equal it."""

import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = sorted(n for n in __spark_entry__.queries() if n[1:2].isdigit() is False or n[:3] in ("p4_", "p6_", "p7_"))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{v:.4f}" if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        theirs = duck.sql(sql)
        assert sorted(theirs.columns) == columns
        assert ours == sorted(tuple(plain(x) for x in r) for r in theirs.select(*columns).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
