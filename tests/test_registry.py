"""Every query of the library's own registry against its SQL, and the shape of the plans.

Optional modules register queries of their own; their tests are beside them.
"""

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALL
from verification import compare, oracle, queries

QUERIES = queries.registry()
SQL = oracle.registry()
#: Python workers of any kind, and joins that compare all with all.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "Pandas", "InArrow", "ArrowEvalPython")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.keys() <= entry_module.queries().keys() and SQL.keys() <= entry_module.oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in FORBIDDEN if operator in plan]
    assert compare.difference(df.toPandas(), con.execute(SQL[name]).fetchdf()) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10 and df.columns[:3] == ["hydroweb", "datetime", "wd01"]


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["series_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<hydroweb:string,reachid:int>" in plan
