"""Every registered query: its plan, and its rows against its SQL."""

import pytest

from checks.compare import compare, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert compare(df, con, name) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
