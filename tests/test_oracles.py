"""Every registered query: equal to its SQL, and planned without row-wise Python or cross joins."""

import pytest

import __spark_entry__ as entry_points
from merchantry.catalog import ORACLES, QUERIES
from tests.oracle import connect, differences

DIRECTORY = "/root/testdata/sf0.001"
# JSON of any depth is merged and stripped on Arrow batches; nothing else leaves the JVM
IN_PYTHON = {"f19_merge_patch", "a2_apply_audit_config", "a3_audit_trail"}
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"]


@pytest.fixture(scope="module")
def database():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    df = QUERIES[name](spark, DIRECTORY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    allowed = {"ArrowEvalPython"} if name in IN_PYTHON else set()
    assert [word for word in UNWANTED if word in plan and word not in allowed] == []
    assert [d for d in differences(df, database, ORACLES[name]) if d != "EMPTY"] == []


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == [
        "customer_segment",
        "customer_count",
        "percentage",
        "avg_total_spent",
        "avg_total_orders",
        "avg_days_since_last_order",
    ]


def test_every_surveyed_group_is_registered():
    wanted = {
        "s": range(1, 8), "p": range(1, 13), "j": range(1, 9), "g": range(1, 13), "w": range(1, 4),
        "o": range(1, 4), "u": range(1, 2), "f": range(1, 23), "t": range(1, 5), "x": range(1, 5),
        "k": range(1, 23), "q": range(1, 10), "a": range(1, 9), "n": range(1, 10),
    }
    prefixes = {name.split("_")[0] for name in QUERIES}
    assert {f"{group}{i}" for group, numbers in wanted.items() for i in numbers} <= prefixes
