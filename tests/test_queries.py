"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from check import compare, connect
from ledgerlens.plans.registry import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()
# Queries whose feature is a Python function, and those with a step of array products or array totals.
PYTHON_STEP = {n for n, q in QUERIES.items() if q.ids.startswith(("X", "G10", "G03", "J09", "D03", "D05", "M12"))}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in PYTHON_STEP:
        assert "EvalPython" not in plan and "InPandas" not in plan
    assert compare(df.toPandas(), duck.execute(QUERIES[name].sql).df()) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["txn_id", "uid_day", "amt_mean", "amt_std", "amt_rel"]
    assert df.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["f03_boolean_ranges"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    assert "l_extendedprice" not in plan
