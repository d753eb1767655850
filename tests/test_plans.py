"""Plan guards: the reconciliation and ingest plans contain no nested-loop or
Cartesian joins (rule lookups must stay equi joins), and rule tables are broadcast."""

import pytest

import __spark_entry__ as E

GUARDED = ["flat_diffs", "x12_diffs", "pairs_status", "ingest_results", "reclassify", "deep_diff", "x12_cardinality"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GUARDED)
def test_no_nested_loop_or_cartesian(spark, sf, name):
    text = plan_text(E.queries()[name](spark, sf))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_rule_lookups_are_broadcast(spark, sf):
    text = plan_text(E.queries()["flat_diffs"](spark, sf))
    assert text.count("BroadcastHashJoin") >= 6  # 3 ignore anti joins + 3 rule lookups
