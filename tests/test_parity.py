"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry
from parity import oracle, queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, problem = difference(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
