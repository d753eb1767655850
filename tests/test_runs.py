"""Stored runs, and the merge of rule tiers."""

import pytest

from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R
from ledgerline.operators.runs import RunStore

PAIRS = "pair_id string, match_value string, occ int, source_file string, source_tx int, target_file string, target_tx int"
DIFFS = ("pair_id string, segment string, field string, severity string, source_value string, target_value string, "
         "description string, wildcard boolean")


def test_the_highest_tiers_rule_wins_whole(spark):
    """A partner's rule inherits nothing of the transaction's; a crosswalk row does."""
    book = (R.RuleBook().rule("transaction", "*", "total", numeric=True, amount_variance=0.01, conditional_qualifier="q")
            .rule("partner", "*", "total", "soft"))
    over = [{"field": "total", "amount_variance": 5.0}, {"field": "new", "severity": "soft"}]
    want = {None: {("*", "total"): ("partner", "soft", False, False, None, None)},
            "x": {("*", "total"): ("crosswalk", "soft", False, False, None, 5.0),
                  ("*", "new"): ("crosswalk", "soft", False, False, None, None)}}
    for key, crosswalk in ((None, None), ("x", over)):
        merged = {(r.segment, r.field): tuple(r[c] for c in ["tier", *R.RULE_ATTRS])
                  for r in R.merge_tiers(R.rules_frame(spark, book, crosswalk)).collect()}
        plain = {(m["segment"], m["field"]): tuple(m[c] for c in ["tier", *R.RULE_ATTRS]) for m in R.merge_config(book, crosswalk)}
        assert merged == plain == want[key]


def test_a_difference_that_the_partner_wants_is_reported(spark):
    book = R.RuleBook().rule("transaction", "*", "total", numeric=True, amount_variance=5.0).rule("partner", "*", "total", numeric=True)
    rows = [("s", 0, "header", 0, [("total", "100.00")]), ("t", 0, "header", 0, [("total", "101.00")])]
    records = spark.createDataFrame(rows, "doc_id string, tx_index int, section string, occ int, fields array<struct<field: string, value: string>>")
    pairs = spark.createDataFrame([("p#1", "p", 1, "s", 0, "t", 0)], PAIRS)
    found = RC.diff_flat(spark, pairs, records.where("doc_id = 's'"), records.where("doc_id = 't'"), book).collect()
    assert [(r.field, r.severity) for r in found] == [("total", "hard")]


@pytest.fixture
def store(spark, tmp_path):
    runs = RunStore(spark, str(tmp_path / "runs"))
    pairs = spark.createDataFrame([("a#1", "a", 1, "s/a", 0, "t/a", 0), ("b#1", "b", 1, "s/b", 0, "t/b", 0),
                                   ("c#1", "c", 1, "s/c", 0, None, None)], PAIRS)
    diffs = spark.createDataFrame([("a#1", "header", "total", "hard", "1", "2", "x", False),
                                   ("b#1", "line_0", "part", "hard", "1", "2", "y", True),
                                   ("b#1", "header", "total", "hard", "3", "4", "z", False)], DIFFS)
    return runs, pairs, diffs


def test_runs_are_stored_and_reclassified(spark, store):
    runs, pairs, diffs = store
    assert runs.runs().count() == runs.pairs().count() == runs.diffs(7).count() == 0
    for _ in range(2):  # a repeated write changes nothing
        runs.write(1, pairs, diffs, "p", "partner", "810", "then")
    assert runs.diffs().count() == 3 and runs.about(1)["mismatched"] == 2
    runs.reclassify(1, 2, R.RuleBook().rule("universal", "*", "*", "soft").rule("partner", "*", "total", "ignore"))
    status = {r.pair_id: (r.status, r.diff_count) for r in runs.pairs(2).collect()}
    assert status == {"a#1": ("MATCH", 0), "b#1": ("MISMATCH", 1), "c#1": ("UNMATCHED", 0)}
    assert [(r.field, r.severity, r.source_value) for r in runs.diffs(2).collect()] == [("part", "soft", "1")]
    assert runs.about(2)["reclassified_from"] == 1 and runs.about(2)["matched"] == 1
    changes = {(r.segment, r.field): r.change for r in runs.compare(1, 2).collect()}
    assert changes == {("header", "total"): "resolved", ("line_0", "part"): "changed"}
    assert runs.report(2).count() == 3
    with pytest.raises(ValueError):
        runs.about(9)
    plan = runs.pairs(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "Join" not in plan


def test_a_run_without_diffs(spark, store):
    runs, pairs, diffs = store
    runs.write(1, pairs, diffs.where("false"))
    assert runs.diffs(1).count() == 0 and runs.about(1)["matched"] == 2 and runs.report(1).count() == 3
