"""The registered queries that SQL can express, and how they are registered."""

import pytest

import __spark_entry__ as entry
from levylens.llm import oracle, queries
from tests.compare import connect, difference


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, scale, name):
    folder = f"/root/testdata/{scale}"
    if scale == "sf0.01" and name == "op5_sharding":
        pytest.skip("the same rows but for more ids")
    _, problem = difference(
        spark, connect(folder), name, queries.queries()[name], oracle.oracle_sql()[name], folder
    )
    assert problem is None, problem


def test_registered():
    names = entry.queries().keys()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names
