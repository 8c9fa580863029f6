"""Every query of the subpackage with SQL against that SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = con.sql(queries.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_queries_without_sql_run(spark):
    for name in sorted(set(queries.queries()) - set(queries.oracle_sql())):
        assert queries.queries()[name](spark, SF).count() >= 0
