"""Every query with a SQL twin gives the same rows, types and names as DuckDB, and
pairs nothing row by row."""

import os

import pytest

from foldstone.workload import ORACLES, QUERIES
from foldstone.workload.check import compare, connect

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df, con, ORACLES[name]) is None


def test_no_twin_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
