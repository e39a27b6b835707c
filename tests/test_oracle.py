"""Every registered query with SQL gives the same rows in Spark and DuckDB."""

import pytest

import quillspark.plans.all  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL
from tests.oracle import both

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    mine, theirs = both(spark, QUERIES[name], SQL[name], SF)
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
