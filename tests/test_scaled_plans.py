"""What a plan makes once: documents, files, parsed transactions; cardinality of odd specifications."""

from pyspark.sql import functions as F

from ledgerline.operators import mapping as M
from ledgerline.operators import staged as ST
from ledgerline.plans import inbound as B
from ledgerline.plans import invoices as I
from ledgerline.sources import jsondocs as J
from ledgerline.sources import x12 as X

SEGMENTS = "doc_id string, tx_index int, seg_pos int, segment string, elements array<string>"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cardinality_counts_in_one_aggregation(spark):
    rows = [("d", 0, i, s, [s]) for i, s in enumerate(["ST", "N1", "N1", "N1", "XX", "SE"])] + [("e", 0, 0, "XX", ["XX"])]
    tx = spark.createDataFrame(rows, SEGMENTS)
    spec = [("ST", 1, 1), ("N1", 0, 2), ("N1", 1, None), ("SE", 1, 1), ("BIG", 1, 1)]
    found = X.cardinality_violations(spark, tx, spec)
    assert plan(found).count("Aggregate") == 1
    assert sorted(map(tuple, found.collect())) == sorted(
        [("d", 0, "N1", 3, "too_many"), ("d", 0, "BIG", 0, "missing_required")]
        + [("e", 0, s, 0, "missing_required") for s in ("ST", "N1", "SE", "BIG")])
    assert X.cardinality_violations(spark, tx, [("N1", 0, None)]).count() == 0


def test_lines_shuffle_only_what_they_need(spark):
    rows = [("d", 0, i, e[0], e) for i, e in enumerate([["ST", "810"], ["IT1", "1", "5"], ["PID", "F", "red"], ["REF", "x"],
                                                          ["IT1", "2", "6"], ["SE", "1"]])]
    tx = spark.createDataFrame(rows, SEGMENTS)
    _, lines = M.map_x12(tx, {"lines": [{"line": "IT1.01", "text": "PID.02"}]})
    assert sorted((r.line_no, r.line, r.text) for r in lines.collect()) == [(0, "1", "red"), (1, "2", None)]
    window = plan(lines).split("Window")[1]
    assert "segment#" in window and "IN (IT1,PID)" in plan(lines)


def test_separators_are_escaped(spark):
    for sep in ("*", "|", "^", ".", "\\", "E", "§"):
        row = spark.createDataFrame([(sep, f"IT1{sep}a{sep}{sep}b")], "s string, t string")
        assert row.select(F.split("t", X._quoted(F.col("s")), -1).alias("v")).first()["v"] == ["IT1", "a", "", "b"], sep


def test_documents_are_made_once(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(J, "store", lambda df: made.append(1) or df)
    docs = spark.createDataFrame([("a", (1, [1, 2])), ("b", (2, [3]))], "doc string, d struct<x: int, l: array<int>>")
    assert J.deep_diff(docs, docs, doc_col="d").count() == 0 and len(made) == 2


def test_lines_are_shuffled_once_for_both_sides(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").limit(0).selectExpr("*", "0 as line_no", "true as is_last")
    rows = I.invoice_records(spark, sf, "source", lines).where("section = 'line'")
    assert shuffles(rows) == 0


def test_the_mailbox_without_invoices_renders_none(spark, sf):
    assert "lineitem" not in plan(B.inbound_files(spark, sf, edi=False)) and "l_orderkey" not in plan(B.inbound_files(spark, sf, edi=False))
    stored = []
    keep = ST.store
    ST.store = lambda df: stored.append(df.columns) or keep(df)
    try:
        files = B.inbound_files(spark, sf, edi=False).limit(5)
        ST.process(spark, files, None, B.staged_config())
    finally:
        ST.store = keep
    assert ["path", "content"] == stored[0][:2] and any("elements" in c for c in stored)
