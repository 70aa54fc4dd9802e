"""Every registered query against its SQL, and what its plan must not contain."""

import pytest

import __spark_entry__ as contract
from docquarry.plans.oracle import ORACLE
from docquarry.plans.registry import QUERIES
from tests.compare import difference, oracle_connection


@pytest.fixture(scope="module")
def connection(sf):
    return oracle_connection(sf)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf, connection, name):
    df = QUERIES[name](spark, sf)
    assert difference(df, connection, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
