"""Every registered query with SQL counterpart gives the same rows at the smallest scale."""

from __future__ import annotations

import os

import pytest
from compare_with_sql import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITH_SQL = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, con, name):
    ok, text = compare(spark, con, SF, name)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_in_the_engine(spark):
    """No row leaves for Python in any table operator, and no big frame is sorted in one task."""
    for name in ("column_profile", "dataset_summary", "correlation_matrix", "split_stratified", "roc_auc", "clean_full"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
