"""Every registered query against its oracle, on the smallest data, and its plan:
no pairing of everything with everything, no Python, no window."""

import pytest

import __spark_entry__ as entry
from check import connect, oracle_result, spark_result
from rowtide.plans import load_all
from tests.conftest import SMALL, plan_of

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = plan_of(df)
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "Window"):
        assert forbidden not in plan
    columns, found = spark_result(df)
    expected_columns, expected = oracle_result(duck, ORACLES[name])
    assert columns == expected_columns
    assert found == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
