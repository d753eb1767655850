"""Flat files rendered from the test tables: one file per order in three
formats, so the readers run over every order and line and their output can
be checked against the tables.

* ``csv/inv_<k>.csv`` – invoice lines; ``|`` when ``k % 2 = 0`` else ``,``
  (declared ``,``: delimiter detection); no header row when ``k % 5 = 0``
  (headerless detection); header names spelled loosely and Part/Supplier
  swapped when ``k % 3 = 0`` (name alignment); the flags cell is quoted and
  contains a comma (quote handling); ship date ``M/d/yyyy``.
* ``mr/inv_<k>.txt`` – pipe multi-record: ``HDR``, a ``NTE`` note when
  ``k % 10 = 0`` (no layout), one ``DTL`` per line (a cell short when
  ``l_partkey % 4 = 0``, one too many when ``l_suppkey % 5 = 0``), ``SUM``.
* ``fw/inv_<k>.dat`` – fixed width: ``FILEHDR`` before the boundary record
  when ``k % 4 = 0``, ``INV_HDR`` (boundary, key ``invoice``), ``INV_DTL``
  with implied-decimal amounts, a ``JUNK`` record when ``k % 9 = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.invoices import numbered_lines
from ledgerline.session import spread, table

# Layouts of the three formats.
CSV_LAYOUT = [("InvoiceNumber", "string"), ("LineNumber", "integer"), ("Part", "string"),
              ("Supplier", "string"), ("Quantity", "float"), ("ExtendedPrice", "float"),
              ("Flags", "string"), ("ShipDate", "date")]
CSV_HEADER = ["InvoiceNumber", "Line Number", "part", "SUPPLIER", "Quantity", "Extended_Price", "Flags", "Ship Date"]
MR_RECORDS = {
    "HDR": ["record_id", "invoice", "date", "customer", "priority"],
    "DTL": ["record_id", "line", "part", "quantity", "price", "flag"],
    "SUM": ["record_id", "line_count", "total_cents"],
}
FW_LAYOUTS = {
    "FILEHDR": [("record_id", 10), ("sender", 10)],
    "INV_HDR": [("record_id", 10), ("invoice", 10), ("date", 8), ("customer", 10, "integer"),
                ("total", 15, "implied_decimal", 2)],
    "INV_DTL": [("record_id", 10), ("line", 4, "integer"), ("part", 10, "integer"),
                ("quantity", 15, "implied_decimal", 2), ("price", 15, "implied_decimal", 2),
                ("flag", 1), ("reserved", 5), ("ship_date", 8)],
}


def _s(c: Column) -> Column:
    return c.cast("string")


def _per_order(orders: DataFrame, lines: DataFrame, line_text: Column, head: list[Column],
               tail: list[Column], path: Column) -> DataFrame:
    """File text per order: header and trailer lines are one projection of
    the order row (NULL = line absent); only the line texts are gathered per
    order, in the partitioning of the line-numbering window."""
    per = (lines.groupBy("l_orderkey")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line_text.alias("t")))),
                                              lambda x: x["t"]), "\n").alias("body"),
                     F.count(F.lit(1)).alias("n")))
    j = spread(orders, "k").join(per, F.col("k") == per.l_orderkey, "left")
    text = F.array_join(F.array(*head, F.col("body"), *tail), "\n")
    return j.select(path.alias("path"), F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(F.lit("")).alias("content"))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    li = numbered_lines(spark, sf_dir).withColumn("k", F.col("l_orderkey"))
    k = F.col("k")
    pipe = k % 2 == 0

    def joined(cells):
        arr = F.array(*cells)
        return F.when(pipe, F.array_join(arr, "|")).otherwise(F.array_join(arr, ","))
    swap = (k % 3 == 0) & (k % 5 != 0)
    hdr_cells = [F.lit(h) for h in CSV_HEADER]
    hdr_swapped = list(hdr_cells)
    hdr_swapped[2], hdr_swapped[3] = hdr_cells[3], hdr_cells[2]
    head = F.when(k % 5 != 0, F.when(swap, joined(hdr_swapped)).otherwise(joined(hdr_cells)))
    flags = F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(", "), F.col("l_linestatus"), F.lit('"'))
    cells = [_s(k), _s(F.col("l_linenumber")), _s(F.col("l_partkey")), _s(F.col("l_suppkey")),
             _s(F.col("l_quantity").cast("decimal(18,2)")), _s(F.col("l_extendedprice").cast("decimal(18,2)")),
             flags, F.date_format("l_shipdate", "M/d/yyyy")]
    swapped = list(cells)
    swapped[2], swapped[3] = cells[3], cells[2]
    line = F.when(swap, joined(swapped)).otherwise(joined(cells))
    return _per_order(o, li, line, [head], [], F.concat(F.lit("csv/inv_"), _s(k), F.lit(".csv")))


def multirecord_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    li = numbered_lines(spark, sf_dir)
    K = F.col("k")
    hdr = F.concat_ws("|", F.lit("HDR"), _s(K), F.date_format("o_orderdate", "yyyyMMdd"), _s(F.col("o_custkey")),
                      F.col("o_orderpriority"))
    nte = F.when(K % 10 == 0, F.concat(F.lit("NTE|see attached terms for invoice "), _s(K)))
    summ = F.concat_ws("|", F.lit("SUM"), _s(F.coalesce(F.col("n"), F.lit(0))),
                       _s(F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")))
    base = [F.lit("DTL"), _s(F.col("line_no") + 1), _s(F.col("l_partkey")),
            _s(F.col("l_quantity").cast("decimal(18,2)")), _s(F.col("l_extendedprice").cast("decimal(18,2)"))]
    short = F.col("l_partkey") % 4 == 0
    long_ = F.col("l_suppkey") % 5 == 0
    text = F.concat_ws("|", *base, F.when(~short, F.col("l_returnflag")), F.when(long_, F.lit("X")))
    return _per_order(o, li, text, [hdr, nte], [summ], F.concat(F.lit("mr/inv_"), _s(K), F.lit(".txt")))


def _fw(c: Column, width: int, pad: str = " ", left: bool = False) -> Column:
    return F.lpad(c, width, pad) if left else F.rpad(c, width, pad)


def fixed_width_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    li = numbered_lines(spark, sf_dir)
    K = F.col("k")
    pre = F.when(K % 4 == 0, F.concat(_fw(F.lit("FILEHDR"), 10), _fw(F.lit("LEDGERLINE"), 10)))
    cents = lambda c: _s(F.round(c.cast("decimal(18,2)") * 100).cast("bigint"))
    hdr = F.concat(_fw(F.lit("INV_HDR"), 10), _fw(_s(K), 10, "0", True), F.date_format("o_orderdate", "yyyyMMdd"),
                   _fw(_s(F.col("o_custkey")), 10, "0", True), _fw(cents(F.col("o_totalprice")), 15, "0", True))
    junk = F.when(K % 9 == 0, F.concat(_fw(F.lit("JUNK"), 10), F.lit("unparsed trailer")))
    dtl = F.concat(
        _fw(F.lit("INV_DTL"), 10), _fw(_s(F.col("line_no") + 1), 4, "0", True), _fw(_s(F.col("l_partkey")), 10, "0", True),
        _fw(cents(F.col("l_quantity")), 15, "0", True), _fw(cents(F.col("l_extendedprice")), 15, "0", True),
        F.col("l_returnflag"), F.lit(" " * 5), F.date_format("l_shipdate", "yyyyMMdd"))
    return _per_order(o, li, dtl, [pre, hdr], [junk], F.concat(F.lit("fw/inv_"), _s(K), F.lit(".dat")))
