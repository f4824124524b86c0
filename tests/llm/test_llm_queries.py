"""Every named query of the training-data operators runs on the smallest tables; those with SQL equal it."""

import os

import pytest

from lodestone.llm import queries
from test_named_queries import DATA, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    sql = queries.oracle_sql().get(name)
    if sql is not None:
        theirs = duck.sql(sql)
        assert sorted(theirs.columns) == columns
        assert ours == sorted(tuple(plain(x) for x in r) for r in theirs.select(*columns).fetchall())
