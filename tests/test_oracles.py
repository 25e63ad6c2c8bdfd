"""Every registered query with an SQL check, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# The larger scale is checked by tests/check.py; these need minutes together and only run there.
SLOW = {"top4_semantic_search", "top4_text_search", "top5_tempo_rerank", "prj11_unified_vector"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(df, con, ORACLES[name]) in (None, "both empty")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
