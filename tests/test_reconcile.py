"""Reconciliation semantics on literal fixtures (rules, alignment, pairing, keys)
and invariants on the test tables (compare(A, A) is clean, swapping sides)."""

from pyspark.sql import functions as F

from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R
from ledgerline.plans import invoices as I
from ledgerline.sources import x12 as X


def isa(el="*", comp=">", ctrl="000000001"):
    parts = ["ISA", "00", " " * 10, "00", " " * 10, "ZZ", "SENDER".ljust(15), "ZZ", "RECEIVER".ljust(15),
             "250115", "1200", "U", "00401", ctrl, "0", "P", comp]
    return el.join(parts)


def interchange(segments, el="*", term="~", newline=False):
    end = term + ("\n" if newline else "")
    body = [isa(el)] + ["GS*IN*S*R*20250115*1200*1*X*004010".replace("*", el)]
    body += [s.replace("*", el) for s in segments]
    body += [f"GE{el}1{el}1", f"IEA{el}1{el}000000001"]
    return end.join(body) + end


SRC = ["ST*810*0001", "BIG*20250115*INV-001", "N1*ST*Acme Corp", "N1*BT*Bill To",
       "IT1*1*10*EA*5.00**VP*123*BP*456", "IT1*2*3*EA*1.50", "SE*7*0001"]
TGT = ["ST*810*0001", "BIG*20250115*INV-001", "N1*ST*ACME CORP",
       "IT1*1*10*EA*5.0**VP*123*BP", "IT1*2*4*EA*1.50", "SE*6*0001"]


def test_isa_is_106_chars():
    assert len(isa()) + 1 == 106


def tiered():
    return (R.RuleBook().rule("universal", "*", "*").ignore("universal", "SE", "SE01").ignore("universal", "ISA", "*")
            .rule("transaction", "N1", "N102", ignore_case=True).rule("transaction", "IT1", "IT104", numeric=True)
            .rule("transaction", "IT1", "IT109", "soft", conditional_qualifier="IT108"))


def run_x12(spark, src_text, tgt_text, rules=None, quals=None):
    files_s = spark.createDataFrame([("s/a.edi", src_text)], "doc_id string, content string")
    files_t = spark.createDataFrame([("t/a.edi", tgt_text)], "doc_id string, content string")
    s, _ = X.parse(files_s)
    t, _ = X.parse(files_t)
    s, t = X.transactions(s), X.transactions(t)
    key = RC.ElementKey("BIG02")
    pairs = RC.pair_documents(RC.match_values_x12(s, key), RC.match_values_x12(t, key))
    q = quals if quals is not None else {"N1": "N101", "IT1": "IT101"}
    return pairs, RC.diff_x12(spark, pairs, s, t, rules or tiered(), q)


def test_parse_separators_and_newlines(spark):
    a = interchange(SRC)
    b = interchange(SRC, el="^", term="~", newline=True)
    fa = spark.createDataFrame([("a", a), ("b", b)], "doc_id string, content string")
    segs, err = X.parse(fa)
    rows = {}
    for r in segs.collect():
        rows.setdefault(r["doc_id"], []).append((r["seg_pos"], r["segment"], tuple(r["elements"])))
    assert sorted(rows["a"]) == sorted(rows["b"])
    assert err.count() == 0
    bad = spark.createDataFrame([("m", "ISA*00* fragment then prose")], "doc_id string, content string")
    segs, err = X.parse(bad)
    assert segs.count() == 0 and err.first()["reason"].startswith("PARSE_FAIL")


def test_transaction_split(spark):
    segs = ["ST*810*1", "A*1", "SE*2*1", "OUT*x", "ST*810*2", "B*1", "ST*810*3", "C*1", "SE*2*3"]
    f = spark.createDataFrame([("d", interchange(segs))], "doc_id string, content string")
    tx = X.transactions(X.parse(f)[0])
    got = sorted((r["tx_index"], r["segment"]) for r in tx.collect())
    assert got == [(0, "A"), (0, "SE"), (0, "ST"), (1, "C"), (1, "SE"), (1, "ST")]


def test_x12_rules(spark):
    pairs, diffs = run_x12(spark, interchange(SRC), interchange(TGT))
    got = {(r["segment"], r["field"], r["severity"]) for r in diffs.collect()}
    # N102 case-insensitive, IT104 numeric, IT109 absent but IT108 present, SE01 ignored
    assert got == {("N1*BT", "", "hard"), ("IT1*2", "IT102", "hard")}
    d = diffs.filter(F.col("field") == "IT102").first()
    assert d["description"] == "Content mismatch: Source='3' vs Target='4'"
    st = RC.pair_status(pairs, diffs).first()
    assert st["status"] == "MISMATCH" and st["diff_count"] == 2


def test_x12_positional_labels(spark):
    _, diffs = run_x12(spark, interchange(SRC), interchange(TGT), quals={})
    labels = {r["segment"] for r in diffs.collect()}
    assert "N1*position_1" in labels and "IT1*position_1" in labels


def test_conditional_qualifier_needs_value(spark):
    tgt = [s.replace("IT1*1*10*EA*5.0**VP*123*BP", "IT1*1*10*EA*5.0**VP*123") for s in TGT]
    _, diffs = run_x12(spark, interchange(SRC), interchange(tgt))
    got = {(r["segment"], r["field"], r["severity"]) for r in diffs.collect()}
    assert ("IT1*1", "IT109", "soft") in got and ("IT1*1", "IT108", "hard") in got


def test_pairing_unmatched_and_surplus(spark):
    s = spark.createDataFrame([("s1", 0, "A"), ("s2", 0, "B")], "doc_id string, tx_index int, match_value string")
    t = spark.createDataFrame([("t1", 0, "A"), ("t2", 0, "A"), ("t3", 0, "C")], "doc_id string, tx_index int, match_value string")
    p = RC.pair_documents(s, t)
    rows = {(r["match_value"], r["occ"]): (r["source_file"], r["target_file"]) for r in p.collect()}
    assert rows == {("A", 1): ("s1", "t1"), ("A", 2): (None, "t2"), ("B", 1): ("s2", None), ("C", 1): (None, "t3")}
    parity = {(r["match_value"], r["occ"]) for r in RC.pair_documents(s, t, parity=True).collect()}
    assert parity == {("A", 1), ("B", 1), ("C", 1)}


def test_composite_key_strict_and(spark):
    segs = ["ST*810*1", "BIG*20250115*INV-1**PO1", "N1*BY*X*92*LINE1", "SE*3*1"]
    f = spark.createDataFrame([("d", interchange(segs)), ("e", interchange(segs[:2] + segs[3:]))],
                              "doc_id string, content string")
    tx = X.transactions(X.parse(f)[0])
    key = RC.ElementKey("BIG04", "N104")
    got = {r["doc_id"]: r["match_value"] for r in RC.match_values_x12(tx, key).collect()}
    assert got == {"d": "PO1\x1fLINE1"}


def test_keys_fit_one_kind_of_document(spark):
    import pytest
    with pytest.raises(TypeError):
        RC.match_values_x12(spark.range(1), RC.PathKey("header.x"))
    with pytest.raises(TypeError):
        RC.match_values_flat(spark.range(1), RC.ElementKey("BIG02"))
    with pytest.raises(ValueError):
        RC.match_values_flat(spark.range(1), RC.PathKey())


def test_flat_key_excludes_remainder(spark):
    recs = spark.createDataFrame([
        ("a", 0, "header", 0, [("invoice_number", "INV-1")]),
        ("b", 0, "header", 0, [("invoice_number", "unknown"), ("_is_split_remainder", "True")]),
        ("c", 0, "header", 0, [("invoice_number", "")]),
    ], "doc_id string, tx_index int, section string, occ int, fields array<struct<field:string,value:string>>")
    got = {r["doc_id"]: r["match_value"] for r in RC.match_values_flat(recs, I.MATCH_KEY).collect()}
    assert got == {"a": "1"}


def test_rule_resolution_tier_vs_wildcard(spark):
    t = R.RuleBook().rule("universal", "N1", "N102").rule("partner", "*", "*", "soft")
    rules = R.rules_frame(spark, t)
    keys = spark.createDataFrame([("N1", "N102"), ("N1", "N103")], "segment string, field string")
    c17 = {r["field"]: (r["severity"], r["wildcard"]) for r in
           R.resolve(keys, R.merge_tiers(rules), seg_col="segment").collect()}
    c18 = {r["field"]: (r["tier"], r["severity"]) for r in R.resolve_with_tier(keys, rules).collect()}
    assert c17 == {"N102": ("hard", False), "N103": ("soft", True)}
    assert c18 == {"N102": ("partner", "soft"), "N103": ("partner", "soft")}


def test_crosswalk_inherits_tier_attributes(spark):
    t = R.RuleBook().rule("universal", "*", "total", numeric=True, amount_variance=0.01)
    rules = R.rules_frame(spark, t, [{"segment": "*", "field": "total", "severity": "soft"}])
    m = R.merge_tiers(rules).first()
    assert (m["severity"], m["numeric"], m["amount_variance"], m["tier"]) == ("soft", True, 0.01, "crosswalk")
    seeded = R.seed_crosswalk(R.rules_frame(spark, t)).collect()
    assert [(r["segment"], r["field"]) for r in seeded] == [("*", "total")]


def test_ignore_list_forms(spark):
    t = (R.RuleBook().ignore("universal", "SE", "SE01").ignore("universal", "ISA", "*")
         .ignore("universal", "*", "REF02"))
    df = spark.createDataFrame([("SE", "SE01"), ("SE", "SE02"), ("ISA", "ISA06"), ("REF", "REF02"), ("N1", "N101")],
                               "rule_segment string, field string")
    kept = {(r[0], r[1]) for r in R.drop_ignored(df, R.ignores_frame(spark, t)).collect()}
    assert kept == {("SE", "SE02"), ("N1", "N101")}


def test_compare_same_is_clean(spark, sf):
    src = I.invoice_records(spark, sf, "source")
    k = RC.match_values_flat(src, I.MATCH_KEY)
    pairs = RC.pair_documents(k, k)
    assert RC.diff_flat(spark, pairs, src, src, I.profile_rules(1)).count() == 0


def test_swapping_sides_swaps_unmatched(spark, sf):
    src, tgt = I.invoice_records(spark, sf, "source"), I.invoice_records(spark, sf, "target")
    ks, kt = RC.match_values_flat(src, I.MATCH_KEY), RC.match_values_flat(tgt, I.MATCH_KEY)
    a = RC.run_summary(RC.pair_status(RC.pair_documents(ks, kt), RC.diff_flat(
        spark, RC.pair_documents(ks, kt), src, tgt, I.profile_rules(1)))).first()
    b = RC.run_summary(RC.pair_status(RC.pair_documents(kt, ks), RC.diff_flat(
        spark, RC.pair_documents(kt, ks), tgt, src, I.profile_rules(1)))).first()
    assert (a["source_only"], a["target_only"]) == (b["target_only"], b["source_only"])
    assert a["total_pairs"] == b["total_pairs"]


def test_python_merge_equals_spark_merge(spark):
    t = I.profile_rules(2)
    xw = [{"segment": "*", "field": "total", "amount_variance": 2.0}, {"segment": "*", "field": "new", "severity": "soft"}]
    a = {(r["segment"], r["field"]): tuple(r[c] for c in ["tier"] + R.RULE_ATTRS)
         for r in R.merge_tiers(R.rules_frame(spark, t, xw)).collect()}
    b = {(m["segment"], m["field"]): tuple(m[c] for c in ["tier"] + R.RULE_ATTRS) for m in R.merge_config(t, xw)}
    assert a == b


def test_occurrence_numbers_hot_key(spark):
    from pyspark.sql import Window
    rows = [("HOT" if i % 3 else f"K{i % 7}", f"d{i:05d}", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "match_value string, doc_id string, tx_index int")
    got = RC.occurrence_numbers(df, "match_value", ["doc_id", "tx_index"])
    w = Window.partitionBy("match_value").orderBy("doc_id", "tx_index")
    want = df.withColumn("occ", F.row_number().over(w))
    key = ["match_value", "doc_id", "tx_index", "occ"]
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert got.count() == 3000


def test_duplicate_field_names_keep_the_last(spark):
    recs = spark.createDataFrame([("a", [("x", "1"), ("y", "2"), ("x", "3")])],
                                 "doc_id string, fields array<struct<field:string,value:string>>")
    from pyspark.sql import functions as F
    assert recs.select(RC.fields_map(F.col("fields")).alias("m")).first()["m"] == {"x": "3", "y": "2"}


def test_occurrence_numbers_without_exchange_reuse(spark):
    from pyspark.sql import functions as F
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("v"),
                                  F.col("id").alias("doc_id"), F.lit(0).alias("tx_index"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = RC.occurrence_numbers(df, "v", ["doc_id", "tx_index"]).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    seen = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        seen[r["v"]] = seen.get(r["v"], 0) + 1
        assert r["occ"] == seen[r["v"]]
    assert len(got) == 6000


def test_large_rule_tables_give_the_same_diffs(spark, monkeypatch):
    want = sorted(map(tuple, run_x12(spark, interchange(SRC), interchange(TGT))[1].collect()))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, run_x12(spark, interchange(SRC), interchange(TGT))[1].collect())) == want
