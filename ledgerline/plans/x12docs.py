"""X12 810 invoices rendered from the test tables, and the X12 profile.

Each order becomes one interchange file (ISA/GS/ST … SE/GE/IEA) with one IT1
segment per line.  The *source* side uses ``*`` between elements and ``~``
after segments; the *target* side uses ``^`` and ``~`` plus a cosmetic
newline, so both separator sniffing and newline stripping are exercised.

Target differences (every order is still rendered): orders ``% 13 = 0`` are
missing from the source and the others ``% 11 = 0`` from the target; BIG02 is
``INV-<key>``; N1*ST name lower-cased when ``% 3 = 0``; DTM*011 absent when
``% 23 = 0``; the last IT1 dropped when ``% 19 = 0``; IT102 ``+1`` when
``l_partkey % 17 = 0``; IT104 printed without trailing zeros; TDS01 ``+100``
cents when ``% 7 = 0``.  CTT01 and SE01 follow the lines actually written.

The SQL oracle builds the same segments as rows straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R
from ledgerline.plans.invoices import numbered_lines, on_side
from ledgerline.session import store, spread, table
from ledgerline.sources import x12 as XS

# Separators per side (element, segment terminator, component).
SEPARATORS = {"source": ("*", "~", ">"), "target": ("^", "~\n", ":"), "book": ("*", "~", ">")}
SENDER, RECEIVER = "LEDGERSRC", "LEDGERTGT"

MATCH_KEY = RC.ElementKey().clean("BIG02", "^INV-|")
COMPOSITE_KEY = RC.ElementKey("BIG04", "N104")

# Qualifier field per segment id (None = align by position).
QUALIFIERS = {"N1": "N101", "REF": "REF01", "DTM": "DTM01", "PER": "PER01", "IT1": "IT101",
              "N3": None, "N4": None}

# The 810 segment list used for the cardinality check (segment, min, max).
SPEC_810 = [("ST", 1, 1), ("BIG", 1, 1), ("N1", 0, 200), ("DTM", 1, 10), ("IT1", 1, 200000),
            ("TDS", 1, 1), ("CTT", 0, 1), ("SE", 1, 1)]


def x12_rules() -> R.RuleBook:
    """The 810 comparison profile."""
    return (R.RuleBook().rule("universal", "*", "*").ignore("universal", "SE", "SE01")
            .rule("transaction", "IT1", "IT102", numeric=True)
            .rule("transaction", "IT1", "IT104", numeric=True)
            .rule("transaction", "IT1", "IT107", conditional_qualifier="IT106")
            .rule("transaction", "N1", "N102", ignore_case=True)
            .rule("transaction", "TDS", "TDS01", numeric=True)
            .rule("transaction", "CTT", "CTT01", "soft")
            .rule("partner", "BIG", "BIG02", "ignore"))


def _s(c: Column) -> Column:
    return c.cast("string")


def interchange_files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One row per file: (doc_id, content).

    Header and trailer segments are one projection per order; only the IT1
    texts are gathered, per order (bounded by the order's lines), in the
    partitioning the line-numbering window already produced – so lineitem is
    shuffled once and orders once.
    """
    el, term, comp = SEPARATORS[side]
    tgt = side == "target"
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    o = spread(on_side(o, side), "o_orderkey")
    lines = numbered_lines(spark, sf_dir)
    if tgt:
        last = F.max("line_no").over(Window.partitionBy("l_orderkey"))
        lines = lines.withColumn("_last", last).filter(
            ~((F.col("l_orderkey") % 19 == 0) & (F.col("line_no") == F.col("_last"))))
    qty = F.col("l_quantity").cast("decimal(18,2)")
    if tgt:
        qty = F.when(F.col("l_partkey") % 17 == 0, qty + 1).otherwise(qty).cast("decimal(18,2)")
    price = _s(F.col("l_extendedprice").cast("decimal(18,2)"))
    if tgt:
        price = F.regexp_replace(F.regexp_replace(price, "0+$", ""), "\\.$", "")
    it1 = F.concat_ws(el, F.lit("IT1"), _s(F.col("line_no") + 1), _s(qty), F.lit("EA"), price, F.lit(""),
                      F.lit("VP"), _s(F.col("l_partkey")), F.lit("SU"), _s(F.col("l_suppkey")))
    per = (lines.groupBy("l_orderkey")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", it1.alias("t")))),
                                              lambda x: x["t"]), term).alias("body"),
                     F.count(F.lit(1)).alias("n")))
    h = o.join(per, key == per.l_orderkey, "left")
    k = _s(key)
    n = F.coalesce(F.col("n"), F.lit(0))
    ymd = F.date_format("o_orderdate", "yyyyMMdd")
    ctrl = F.lpad(k, 9, "0")
    has_dtm = (key % 23 != 0) if tgt else F.lit(True)
    inv = F.concat(F.lit("INV-"), k) if tgt else k
    st_name = F.when(key % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")) if tgt \
        else F.col("o_orderpriority")
    cents = F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    if tgt:
        cents = cents + F.when(key % 7 == 0, F.lit(100)).otherwise(F.lit(0))

    def seg(*els):
        return F.concat_ws(el, *[e if isinstance(e, Column) else F.lit(e) for e in els])

    segments = F.array(
        seg("ISA", "00", " " * 10, "00", " " * 10, "ZZ", SENDER.ljust(15), "ZZ", RECEIVER.ljust(15),
            F.date_format("o_orderdate", "yyMMdd"), "0000", "U", "00401", ctrl, "0", "P", comp),
        seg("GS", "IN", SENDER, RECEIVER, ymd, "0000", k, "X", "004010"),
        seg("ST", "810", "0001"),
        seg("BIG", ymd, inv, "", F.concat(F.lit("PO"), k)),
        seg("N1", "BY", F.concat(F.lit("CUSTOMER "), _s(F.col("o_custkey"))), "92", _s(F.col("o_custkey"))),
        seg("N1", "ST", st_name, "92", _s(F.col("o_custkey"))),
        F.when(has_dtm, seg("DTM", "011", ymd)),
        F.col("body"),
        seg("TDS", _s(cents)),
        seg("CTT", _s(n)),
        seg("SE", _s(n + 6 + has_dtm.cast("int")), "0001"),
        seg("GE", "1", k),
        seg("IEA", "1", ctrl))
    content = F.concat(F.array_join(segments, term), F.lit(term))
    return h.select(F.concat(F.lit(f"{side}/810_"), k, F.lit(".edi")).alias("doc_id"), content.alias("content"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's interchanges with several transaction types, by ``o_orderkey % 5``: 1 is a
    purchase order (850), 2 an acknowledgement without a map (997), 3 an invoice and a purchase
    order in one file, the others invoices, of which those of ``% 40 = 4`` name no type."""
    files = interchange_files(spark, sf_dir, "book").withColumns({
        "_k": F.regexp_extract("doc_id", r"(\d+)\.edi", 1).cast("long"), "_at": F.instr("content", "~ST*") + 1,
        "_end": F.instr("content", "~GE*") + 1})
    body = F.substring(F.col("content"), F.col("_at"), F.col("_end") - F.col("_at"))
    rows = files.select("doc_id", "_k", body.alias("_body"), F.substring(F.col("content"), F.lit(1), F.col("_at") - 1).alias("_head"),
                        F.substring(F.col("content"), F.col("_end"), F.length("content")).alias("_tail"))
    order = F.col("_body")
    for old, new in (("ST*810*", "ST*850*"), ("~BIG*", "~BEG*"), ("~IT1*", "~PO1*")):
        order = F.replace(order, F.lit(old), F.lit(new))
    kind, plain = F.col("_k") % 5, F.col("_body")
    changed = (F.when(kind == 1, order).when(kind == 2, F.replace(plain, F.lit("ST*810*"), F.lit("ST*997*")))
               .when(kind == 3, F.concat(plain, order))
               .when(F.col("_k") % 40 == 4, F.replace(plain, F.lit("ST*810*"), F.lit("ST**"))).otherwise(plain))
    return rows.select("doc_id", F.concat("_head", changed, "_tail").alias("content"))


# Maps by transaction type, and the segment that opens a line.
REGISTRY = {
    "810": {"header": {"invoice_number": "BIG.02", "po_number": "BIG.04", "customer": {"source": "N1.04", "transform": "to_int"}},
            "summary": {"total_cents": {"source": "TDS.01", "transform": "to_int"}},
            "lines": [{"line": {"source": "IT1.01", "transform": "to_int"}, "part": "IT1.07"}]},
    "850": {"header": {"po_number": "BEG.04", "reference": "BEG.02"},
            "summary": {"line_count": {"source": "CTT.01", "transform": "to_int"}},
            "lines": [{"line": {"source": "PO1.01", "transform": "to_int"}, "part": "PO1.07", "quantity": "PO1.02"}]},
}
LINE_SEGMENTS = {"810": "IT1", "850": "PO1"}


def parsed_transactions(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return XS.parse_transactions(interchange_files(spark, sf_dir, side))[0]


def stored_transactions(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """The parsed transactions, a row each, written once to the checkpoint folder."""
    return store(XS.whole_transactions(interchange_files(spark, sf_dir, side))[0])


def x12_run(spark: SparkSession, sf_dir: str):
    """Pairs and diffs of the X12 reconciliation (render -> parse -> compare)."""
    src, tgt = stored_transactions(spark, sf_dir, "source"), stored_transactions(spark, sf_dir, "target")
    pairs = store(RC.pair_documents(*[RC.match_values_x12(XS.segments_of(side), MATCH_KEY) for side in (src, tgt)]))
    tiered = x12_rules()
    quals = R.effective_qualifiers(tiered, QUALIFIERS)
    diffs = RC.diff_x12(spark, pairs, src, tgt, tiered, quals)
    return pairs, diffs
