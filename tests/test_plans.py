"""Plans: no pair-producing joins, filters and columns reach the scan."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = set(entry.oracle_sql())  # their plans are checked together with their results


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in CHECKED])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_column_pruning(spark):
    text = plan(spark, "flt5_metadata_search")
    scan = [ln for ln in text.splitlines() if "FileScan" in ln][0]
    assert "text:string" not in scan


def test_filter_pushdown(spark):
    text = plan(spark, "flt9_period_filter")
    assert "EqualTo(event_type,view)" in text
