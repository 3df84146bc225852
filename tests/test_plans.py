"""Plan-shape guards: no cartesian products, no nested-loop joins, no
row-at-a-time Python; filters and column subsets reach the scan; the
distribution build shuffles once; group limits replace global sorts."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan(spark, key):
    df = E.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_no_forbidden_operators(spark, key):
    p = plan(spark, key)
    assert not [w for w in FORBIDDEN if w in p]


def test_pushdown_and_pruning(spark):
    p = plan(spark, "scan_pruned_columns")
    assert "EqualTo(lang,fr)" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in p


def test_distribution_build_shuffles_once(spark):
    p = plan(spark, "mean_js_by_level")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in p
    assert p.count("Exchange hashpartitioning(itemid") == 1
    assert "SortMergeJoin" not in p


def test_batch_mean_uses_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "batch_mean_js")
