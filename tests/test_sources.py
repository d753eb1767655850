"""Readers on literal fixtures: fixed width, delimited, multi-record, fill-forward, XML, JSON."""

import math

from pyspark.sql import functions as F

from ledgerline.sources import delimited as D
from ledgerline.sources import fixedwidth as FW
from ledgerline.sources import jsondocs as J
from ledgerline.sources import xml as XS


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_fixed_width_slices_and_blanks(spark):
    layouts = {"HDR": [("record_id", 10), ("name", 5), ("n", 3, "integer")],
               "AMT": [("record_id", 10), ("amount", 6, "implied_decimal", 2), ("blank", 5), ("tail", 2)]}
    f = files(spark, ("f", "HDR       Hello 42\nAMT       001234     ok\nXXX       junk\n"))
    recs, unknown = FW.read_fixed_width(f, layouts)
    r = {x["record_id"]: x for x in recs.collect()}
    assert (r["HDR"]["HDR"]["name"], r["HDR"]["HDR"]["n"]) == ("Hello", 42)
    amt = r["AMT"]["AMT"]
    assert float(amt["amount"]) == 12.34 and amt["blank"] is None and amt["tail"] == "ok"
    assert [x["record_id"] for x in unknown.collect()] == ["XXX"]


def test_delimiter_and_header_detection(spark):
    df = spark.createDataFrame([("a|b|c,d",), ("a,b,c",), ("a\tb\tc|d|e|f",), ("x",)], "l string")
    got = [r[0] for r in df.select(D.detect_delimiter(F.col("l"), ",")).collect()]
    assert got == ["|", ",", "|", ","]
    h = spark.createDataFrame([("Name,Qty",), ("foo,1",)], "l string")
    got = [r[0] for r in h.select(D.has_header(F.col("l"), F.lit(","), ["Qty", "Price"])).collect()]
    assert got == [True, False]


def test_read_delimited_alignment_quotes_headerless(spark):
    cols = [("InvoiceNumber", "string"), ("Qty", "float"), ("Note", "string")]
    f = files(spark,
              ("a.csv", 'Note|qty|InvoiceNumber\n"x, y"|2|A1\n'),
              ("b.csv", 'B1,3.5,"p, q"\n'))
    rows = {r["path"]: r for r in D.read_delimited(f, cols, ",").collect()}
    assert (rows["a.csv"]["InvoiceNumber"], rows["a.csv"]["Qty"], rows["a.csv"]["Note"]) == ("A1", 2.0, "x, y")
    assert (rows["b.csv"]["InvoiceNumber"], rows["b.csv"]["Qty"], rows["b.csv"]["Note"]) == ("B1", 3.5, "p, q")


def test_multirecord_pad_cut_unknown(spark):
    recs = {"H": ["record_id", "a", "b"], "D": ["record_id", "x", "y", "z"]}
    f = files(spark, ("m", "H|1|2\nD|1\nD|1|2|3|4\nQ|zz\n"))
    parsed, unknown = D.read_multirecord(f, recs, "|")
    d = [r["fields"] for r in parsed.filter(F.col("record_id") == "D").orderBy("line_no").collect()]
    assert d[0]["z"] is None and d[1]["z"] == "3"
    assert [r["record_id"] for r in unknown.collect()] == ["Q"]
    inv = D.record_inventory(parsed, unknown, recs, spark)
    assert {r["record_id"]: r["max_cells"] for r in inv.collect()} == {"H": 3, "D": 5, "Q": 2}


def test_fill_forward_with_null_boundary_reset(spark):
    rows = spark.createDataFrame([
        ("f", 0, "PRE", None, "own0"), ("f", 1, "HDR", "K1", None), ("f", 2, "DTL", None, "own2"),
        ("f", 3, "HDR", None, None), ("f", 4, "DTL", None, "own4"), ("g", 0, "DTL", None, None)],
        "path string, line_no int, rid string, key string, own string")
    k = D.fill_forward_key(rows, F.col("rid") == "HDR", F.col("key"), F.col("own"))
    got = {(r["path"], r["line_no"]): r["k"] for r in rows.select("path", "line_no", k.alias("k")).collect()}
    assert got == {("f", 0): "own0", ("f", 1): "K1", ("f", 2): "K1", ("f", 3): None, ("f", 4): "own4", ("g", 0): None}


def test_layout_clash_and_type_merge(spark):
    clash = D.layout_clashes(spark, [("A", ["x"]), ("A", ["y"]), ("B", [])])
    assert sorted(r["record_id"] for r in clash.collect()) == ["A", "B"]
    m = {r["name"]: r["merged_type"] for r in D.merge_types(spark, [[("q", "integer"), ("d", "date")],
                                                                   [("q", "float"), ("d", "string")]]).collect()}
    assert m == {"q": "float", "d": "date"}


def test_cxml_attributes_and_line_discovery(spark):
    doc = ('<cXML><Request><OrderRequest><OrderRequestHeader orderID="PO-001" type="new"><Total/></OrderRequestHeader>'
           '<OrderRequestDetail><OrderRequestLine lineNumber="1" quantity="10"/><OrderRequestLine lineNumber="2" '
           'quantity="5"/></OrderRequestDetail></OrderRequest></Request></cXML>')
    f = files(spark, ("p.cxml", doc))
    rows = XS.cxml_attributes(f, ["orderID", "type"], ["lineNumber", "quantity"]).orderBy("line_index").collect()
    assert [(r["header.@orderID"], r["line.@lineNumber"], r["line.@quantity"]) for r in rows] == \
        [("PO-001", "1", "10"), ("PO-001", "2", "5")]
    g = files(spark, ("g.xml", "<R><Detail n='1'/><Detail n='2'/><Item/></R>"))
    r = XS.discover_lines(g).first()
    assert (r["line_element"], r["n_lines"]) == ("Detail", 2)


def test_json_read_nan_and_failures(spark):
    f = files(spark, ("a.json", '{"header": {"x": NaN, "y": "1"}}'), ("b.json", "{not json"))
    docs, bad = J.read_json_docs(f, "header struct<x double, y string>")
    assert docs.first()["doc"]["header"]["x"] is None
    assert [r["path"] for r in bad.collect()] == ["b.json"]


def test_deep_diff_semantics(spark):
    schema = "k string, doc struct<a double, s string, skip string, n double, l array<struct<v int>>>"
    e = spark.createDataFrame([("d", (1.0, "x", "p", float("nan"), [(1,), (2,)])),
                               ("e", (1.0, "x", "p", 1.0, [(1,)]))], schema)
    a = spark.createDataFrame([("d", (1.009, "x", "q", float("nan"), [(1,)])),
                               ("e", (1.02, "y", "p", 1.0, [(3,)]))], schema)
    got = {(r["k"], r["path"], r["kind"]) for r in J.deep_diff(e, a, key="k", skip={"skip"}).collect()}
    assert got == {("d", "l", "length"), ("e", "a", "value"), ("e", "s", "value"), ("e", "l[0].v", "value")}
    assert not math.isnan(1.0)


def test_split_documents(spark, tmp_path):
    lines = spark.createDataFrame([("f", i, None if i < 2 else f"K{i % 2}") for i in range(8)],
                                  "path string, row_no int, key string")
    split = J.split_documents(lines, "key")
    got = sorted((r["split_key"], r["occ"], r["row_no"], r["is_split_remainder"]) for r in split.collect())
    assert got == [("K0", 1, 2, False), ("K0", 2, 4, False), ("K0", 3, 6, False), ("K1", 1, 3, False), ("K1", 2, 5, False),
                   ("K1", 3, 7, False), ("unknown", 1, 0, True), ("unknown", 2, 1, True)]
    J.write_split_documents(split, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 8


def test_wide_header_and_quoted_newline(spark):
    wide = ",".join(f"x{i}" for i in range(7)) + ",amt\n" + ",".join("0" * 7) + ",99\n"
    f = files(spark, ("w.csv", wide), ("n.csv", 'amt,x0\n5,"one\ntwo ""q"""\n6,\n'))
    rows = sorted((r["path"], r["row_no"], r["amt"], r["x0"]) for r in
                  D.read_delimited(f, [("amt", "float"), ("x0", "string")]).collect())
    assert rows == [("n.csv", 0, 5.0, 'one\ntwo "q"'), ("n.csv", 1, 6.0, None), ("w.csv", 0, 99.0, "0")]


def test_format_by_how_content_starts(spark):
    from ledgerline.sources.files import detect_format
    df = spark.createDataFrame([("ISA~00~x",), ("  ST*810*1",), (" \n<a/>",), ("words < and ST* more",), ("ISAAC said",)], "c string")
    assert [r[0] for r in df.select(detect_format(F.lit("dunno"), F.col("c"))).collect()] == ["x12", "x12", "xml", None, None]


def test_deep_diff_lists_in_lists_and_one_sided_documents(spark):
    schema = "k string, doc struct<tags array<string>, l array<struct<m array<int>>>>"
    e = spark.createDataFrame([("d", (["a", "b"], [([1],)])), ("only", (["a"], []))], schema)
    a = spark.createDataFrame([("d", (["a", "Z"], [([9],)])), ("new", (["a"], []))], schema)
    got = {(r["k"], r["path"], r["kind"]) for r in J.deep_diff(e, a, key="k").collect()}
    assert got == {("d", "tags[1]", "value"), ("d", "l[0].m[0]", "value"), ("only", "", "missing_document"),
                   ("new", "", "unexpected_document")}
    flat = spark.createDataFrame([("d", (1,))], "k string, doc struct<a int>")
    assert J.deep_diff(flat, flat, key="k").count() == 0


def test_malformed_xml_stops_nothing(spark):
    good = ("<cXML><Request><OrderRequest><OrderRequestHeader orderID='1'/><OrderRequestDetail><OrderRequestLine lineNumber='1'/>"
            "<OrderRequestLine lineNumber='2' quantity='7'/></OrderRequestDetail></OrderRequest></Request></cXML>")
    f = files(spark, ("good", good), ("bad", "<cXML><Request>"), ("none", None), ("punch", "<cXML><Message><PunchOutOrderMessage>"
              "<PunchOutOrderMessageHeader orderID='p'/><ItemIn quantity='3'/></PunchOutOrderMessage></Message></cXML>"))
    rows = sorted((r["path"], r["header.@orderID"], r["line.@lineNumber"] or "", r["line.@quantity"] or "")
                  for r in XS.cxml_attributes(f, ["orderID"], ["lineNumber", "quantity"]).collect())
    assert rows == [("good", "1", "1", ""), ("good", "1", "2", "7"), ("punch", "p", "", "3")]
    assert sorted(r["path"] for r in XS.xml_failures(f).collect()) == ["bad", "none"]
    assert XS.discover_lines(f).count() == XS.parse_variant(f).count() == 4


def test_over_long_implied_decimals_are_null(spark):
    layout = {"R": [("id", 1), ("amount", 60, "implied_decimal", 2), ("plain", 5, "implied_decimal", 0)]}
    lines = ["R" + "9" * 45 + " " * 15 + "00042", "R" + "-1".rjust(60) + "x1   ", "R" + "12345".rjust(60) + "-7   ", "R" + "9" * 36]
    df = spark.createDataFrame([("f", "\n".join(lines))], "path string, content string")
    rows, _ = FW.read_fixed_width(df, layout)
    got = [(r.R.amount and str(r.R.amount), r.R.plain and int(r.R.plain)) for r in rows.orderBy("line_no").collect()]
    assert got == [(None, 42), ("-0.01", None), ("123.45", -7), ("9" * 34 + ".99", None)]
