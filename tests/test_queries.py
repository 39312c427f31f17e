"""Every registered query with SQL against DuckDB over whole tables; the entry's contract."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle
from skein.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(DIR)


@pytest.mark.parametrize("name", [k for k, (_, sql) in registry.QUERIES.items() if sql])
def test_query_equals_sql(spark, con, name):
    run, sql = registry.QUERIES[name]
    assert difference(run(spark, DIR).toPandas(), con.sql(sql).df()) == ""


@pytest.mark.parametrize("name", [k for k, (_, sql) in registry.QUERIES.items() if not sql])
def test_query_without_sql_runs(spark, name):
    assert not registry.QUERIES[name][0](spark, DIR).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "hop", "risk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
