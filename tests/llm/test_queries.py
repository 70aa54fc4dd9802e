"""The queries that SQL can express against their SQL, over the smallest tables."""

import pytest

from docquarry.llm.queries import ORACLE, QUERIES
from tests.compare import difference, oracle_connection


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert difference(df, oracle_connection(sf), ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
