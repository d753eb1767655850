"""What the queries of round 4's findings do at size: the same results from less work."""

import os

from pyspark.sql import functions as F

from ledgerline import carry
from ledgerline.functions import transforms as TF
from ledgerline.llm import shared
from ledgerline.operators import reconcile as RC
from ledgerline.plans import invoices as I
from ledgerline.plans import queries_x12 as QX
from ledgerline.plans import x12docs as XD
from ledgerline.sources import fixedwidth as FW
from ledgerline.sources import jsondocs as J
from ledgerline.sources import x12 as X12
from ledgerline.sources import xml as XML


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_implied_decimals_match_their_text_once(spark):
    texts = ["12345", "+00012", "-7", "0", "x1", "", "1.5", "12E3", "9" * 38, "9" * 39, "0" * 50 + "12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("line", F.rpad("t", 60, " "))
    got = df.select("t", FW._value(F.col("line"), 0, 60, "implied_decimal", 2, True).alias("v"))
    assert [str(r.v) for r in got.collect()] == ["123.45", "0.12", "-0.07", "0.00", "None", "None", "None", "None",
                                                 "9" * 36 + ".99", "None", "0.12"]
    assert plan(got).count("regexp_extract") == 1
    assert "regexp_replace" not in plan(df.select(TF.to_int(F.col("t"))))


def test_lines_are_counted_without_making_documents(spark):
    texts = ["<a><Item x='1'/><Item/><Item><q r='2'/></Item></a>", "<a><b x='1'/><b/></a>", "<a><b/><b/></a>", "bad", None, "<a/>",
             "<Item><Item a='1'><Item/></Item></Item>", "<n:a xmlns:n='u'><n:r x='1'/><n:r/></n:a>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    walked = XML.walk(df, cxml=False).select("i", F.when(F.size("lines") > 0, F.col("line_element")), F.greatest(F.size("lines"), F.lit(0)))
    found = XML.discover_lines(df)
    assert sorted(map(tuple, found.select("i", "line_element", "n_lines").collect())) == sorted(
        (i, tag, n or 0) for i, tag, n in map(tuple, walked.collect()))
    assert "_walked" not in plan(found)


def test_documents_are_compared_within_the_row(spark):
    kind = "k string, doc struct<a: double, ls: array<struct<x: int, ys: array<int>>>>"
    e = spark.createDataFrame([("one", (1.0, [(1, [1, 2]), (2, None)])), ("cut", (1.0, [(1, [1])])), ("gone", (1.0, []))], kind)
    a = spark.createDataFrame([("one", (1.0, [(1, [1, 3]), (2, [5])])), ("cut", (1.5, [(1, [1, 2]), (2, [3])])), ("new", (1.0, []))], kind)
    found = J.deep_diff(e, a, key="k")
    want = {("one", "ls[0].ys[1]", "value", None, 2.0, 3.0), ("one", "ls[1].ys[0]", "unexpected", None, None, 5.0),
            ("cut", "a", "value", None, 1.0, 1.5), ("cut", "ls", "length", "1", None, None), ("cut", "ls[0].ys", "length", "1", None, None),
            ("gone", "", "missing_document", None, None, None), ("new", "", "unexpected_document", None, None, None)}
    assert {(r.k, r.path, r.kind, r.expected, r.expected_num, r.actual_num) for r in found.collect()} == want
    assert plan(found).count("Join") == 1  # of documents; leaves are not joined
    # a key that comes twice is compared leaf by leaf: each value meets each, a list that differs once is in no other row
    twice = J.deep_diff(e.unionByName(e.where("k = 'one'")), a, key="k").collect()
    assert sorted((r.path, r.kind) for r in twice if r.k == "one") == [("ls[0].ys[1]", "value")] * 2 + [("ls[1].ys[0]", "unexpected")]


def _interchange(name, *transactions):
    isa = "ISA*00*" + " " * 10 + "*00*" + " " * 10 + "*ZZ*" + "S".ljust(15) + "*ZZ*" + "R".ljust(15) + "*250101*0000*U*00401*000000001*0*P*>~"
    assert len(isa) == 106
    return name, isa + "".join(f"ST*810*1~{'~'.join(t)}~SE*9*1~" for t in transactions) + "IEA*1*1~"


def test_whole_transactions_give_the_diffs_of_their_segments(spark):
    src = [_interchange("s1", ["BIG*1*7", "IT1*1*5", "IT1*1*6", "N1*BY*A"], ["BIG*1*8", "TDS*5"], ["TDS*1"]),
           _interchange("s2", ["BIG*1*9", "IT1*1*5"])]
    tgt = [_interchange("t1", ["BIG*1*INV-8", "TDS*6", "TDS*7"]), _interchange("t2", ["BIG*1*INV-7", "IT1*1*5", "IT1*1*9", "N1*BY*B"]),
           _interchange("t3", ["BIG*1*10"])]
    quals = {"N1": "N101", "IT1": "IT101"}
    sides = [spark.createDataFrame(rows, "doc_id string, content string") for rows in (src, tgt)]
    whole, parsed = ([f(side)[0] for side in sides] for f in (X12.whole_transactions, X12.parse_transactions))
    assert sorted(map(tuple, X12.segments_of(whole[0]).select(parsed[0].columns).collect())) == sorted(map(tuple, parsed[0].collect()))
    pairs = RC.pair_documents(*[RC.match_values_x12(t, XD.MATCH_KEY) for t in parsed])
    want, got = (sorted(map(tuple, RC.diff_x12(spark, pairs, *t, XD.x12_rules(), quals).collect()), key=repr) for t in (parsed, whole))
    assert got == want and {r[0] for r in want} == {"7#1", "8#1"} and any("Extra segment" in r[6] for r in want)
    assert plan(RC.placed(pairs.localCheckpoint(), *whole)).count("Join") == 1  # targets with their pairs; the sides are not joined


def test_documents_of_no_pair_are_dropped_where_sides_meet(spark):
    schema = "doc_id string, tx_index int, section string, occ int, fields array<struct<field: string, value: string>>"
    src = spark.createDataFrame([(d, 0, "line", 0, [("a", d)]) for d in ("s", "alone", "none")], schema)
    tgt = spark.createDataFrame([("t", 0, "line", 0, [("a", "1")]), ("t", 0, "line", 1, [("a", "2")]), ("other", 0, "line", 0, [("a", "3")])], schema)
    pairs = spark.createDataFrame([("p#1", "p", 1, "s", 0, "t", 0), ("q#1", "q", 1, "alone", 0, None, None)],
                                  "pair_id string, match_value string, occ int, source_file string, source_tx int, target_file string, target_tx int")
    for side in (src, RC.flat_packed(src)):
        rows = RC.diff_flat(spark, pairs, side, tgt, I.profile_rules(1)).collect()
        assert sorted((r.pair_id, r.segment, r.field, r.target_value) for r in rows) == [("p#1", "line_0", "a", "1"), ("p#1", "line_1", "", "{'a': '2'}")]


def test_large_files_move_only_elements_that_are_read(spark, sf, monkeypatch):
    stored, keep = [], carry.store
    monkeypatch.setattr(carry, "store", lambda df: stored.append(out := keep(df)) or out)
    QX.x12_large_transactions(spark, sf)
    named = stored[0].where("elements is not null").select("segment").distinct().collect()
    assert [r.segment for r in named] == ["BIG"]


def test_intermediate_texts_are_compressed(spark):
    rows = shared.write_through(spark.range(10), "small")
    assert rows.count() == 10 and all("zstd" in os.path.basename(f) for f in rows.inputFiles())
