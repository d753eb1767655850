"""Registered flat-file queries: render with Spark -> parse -> compare with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.plans import flatfiles as FF
from ledgerline.plans import invoices as I
from ledgerline.plans.queries import register
from ledgerline.session import table
from ledgerline.sources import delimited as D
from ledgerline.sources import fixedwidth as FW

_LI = f"""WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(I.LINE_ORDER)}) - 1 AS line_no
  FROM lineitem)
"""


@register("delim_detect", """SELECT 'csv/inv_' || o_orderkey || '.csv' AS path,
  CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 5 <> 0 OR coalesce(n, 0) > 0) THEN '|' ELSE ',' END AS delimiter,
  (o_orderkey % 5 <> 0) AS has_header
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def delim_detect(spark, sf):
    """Delimiter and header row detected per file from its first line."""
    names = [n for n, _ in FF.CSV_LAYOUT]
    f = FF.csv_files(spark, sf).withColumn("_first", D.first_line(F.col("content")))
    d = D.detect_delimiter(F.col("_first"), ",")
    return f.select("path", d.alias("delimiter"), D.has_header(F.col("_first"), d, names).alias("has_header"))


@register("csv_roundtrip", _LI + """SELECT 'csv/inv_' || l_orderkey || '.csv' AS path, line_no AS row_no,
  CAST(l_orderkey AS VARCHAR) AS InvoiceNumber, CAST(l_linenumber AS BIGINT) AS LineNumber,
  CAST(l_partkey AS VARCHAR) AS Part, CAST(l_suppkey AS VARCHAR) AS Supplier,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS Quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS ExtendedPrice,
  l_returnflag || ', ' || l_linestatus AS Flags, strftime(l_shipdate, '%Y-%m-%d') AS ShipDate
FROM li""")
def csv_roundtrip(spark, sf):
    """Typed rows of every CSV file (quotes, header alignment, headerless)."""
    return D.read_delimited(FF.csv_files(spark, sf), FF.CSV_LAYOUT, ",", "%m/%d/%Y").drop("_raw")


@register("multirecord_parse", _LI + """SELECT 'mr/inv_' || l_orderkey || '.txt' AS path,
  line_no + CASE WHEN l_orderkey % 10 = 0 THEN 2 ELSE 1 END AS line_no,
  CAST(line_no + 1 AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
  CASE WHEN l_partkey % 4 <> 0 THEN l_returnflag WHEN l_suppkey % 5 = 0 THEN 'X' END AS flag,
  CAST(l_orderkey AS VARCHAR) AS invoice
FROM li""")
def multirecord_parse(spark, sf):
    """DTL records (short rows padded, long rows cut) with the invoice of their HDR."""
    recs, _ = D.read_multirecord(FF.multirecord_files(spark, sf), FF.MR_RECORDS, "|")
    inv = D.fill_forward_key(recs, F.col("record_id") == "HDR", F.col("fields")["invoice"])
    r = recs.withColumn("invoice", inv).filter(F.col("record_id") == "DTL")
    return r.select("path", "line_no", *[F.col("fields")[n].alias(n) for n in FF.MR_RECORDS["DTL"][1:]], "invoice")


@register("record_inventory", """SELECT * FROM (
  SELECT 'HDR' AS record_id, count(*) AS n_rows, 5 AS min_cells, 5 AS max_cells, 5 AS declared_cells FROM orders
  UNION ALL SELECT 'SUM', count(*), 3, 3, 3 FROM orders
  UNION ALL SELECT 'NTE', count(*), 2, 2, NULL FROM orders WHERE o_orderkey % 10 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'DTL', count(*), min(c), max(c), 6 FROM (
    SELECT 6 - CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS c
    FROM lineitem) HAVING count(*) > 0)""")
def record_inventory(spark, sf):
    """Rows and cell counts per record id against the declared layout (unknown ids included)."""
    recs, unknown = D.read_multirecord(FF.multirecord_files(spark, sf), FF.MR_RECORDS, "|")
    return D.record_inventory(recs, unknown, FF.MR_RECORDS, spark)


@register("fixedwidth_parse", _LI + """SELECT 'fw/inv_' || l_orderkey || '.dat' AS path,
  line_no + 1 + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS line_no,
  CAST(line_no + 1 AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS part,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS price,
  l_returnflag AS flag, CAST(NULL AS VARCHAR) AS reserved, strftime(l_shipdate, '%Y%m%d') AS ship_date,
  lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS invoice
FROM li""")
def fixedwidth_parse(spark, sf):
    """Fixed-width detail records, implied decimals kept, blanks as NULL, invoice filled forward."""
    recs, _ = FW.read_fixed_width(FF.fixed_width_files(spark, sf), FF.FW_LAYOUTS)
    inv = D.fill_forward_key(recs, F.col("record_id") == "INV_HDR", F.col("INV_HDR.invoice"))
    r = recs.withColumn("invoice", inv).filter(F.col("record_id") == "INV_DTL")
    names = [f[0] for f in FF.FW_LAYOUTS["INV_DTL"][1:]]
    return r.select("path", "line_no", *[F.col(f"INV_DTL.{n}").alias(n) for n in names], "invoice")


@register("key_fill_forward", _LI + """SELECT path, line_no, record_id, invoice_key FROM (
  SELECT 'fw/inv_' || o_orderkey || '.dat' AS path, 0 AS line_no, 'FILEHDR' AS record_id, CAST(NULL AS VARCHAR) AS invoice_key
    FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'fw/inv_' || o_orderkey || '.dat', CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, 'INV_HDR',
    lpad(CAST(o_orderkey AS VARCHAR), 10, '0') FROM orders
  UNION ALL SELECT 'fw/inv_' || l_orderkey || '.dat', line_no + 1 + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END,
    'INV_DTL', lpad(CAST(l_orderkey AS VARCHAR), 10, '0') FROM li)""")
def key_fill_forward(spark, sf):
    """Boundary key carried to every following record; records before it keep their own (none)."""
    recs, _ = FW.read_fixed_width(FF.fixed_width_files(spark, sf), FF.FW_LAYOUTS)
    inv = D.fill_forward_key(recs, F.col("record_id") == "INV_HDR", F.col("INV_HDR.invoice"))
    return recs.select("path", "line_no", "record_id", inv.alias("invoice_key"))


@register("key_fill_forward_large", _LI + """, rows AS (
  SELECT o_orderkey AS o, 0 AS line_no, 'FILEHDR' AS record_id FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, 'INV_HDR' FROM orders
  UNION ALL SELECT l_orderkey, line_no + 1 + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END, 'INV_DTL' FROM li),
placed AS (
  SELECT CASE WHEN o % 3 = 0 THEN 'fw/batch.dat' ELSE 'fw/inv_' || o || '.dat' END AS path, o, line_no AS l, record_id FROM rows)
SELECT path, o AS source_order, l AS line_no, record_id,
  lpad(CAST(max(CASE WHEN record_id = 'INV_HDR' THEN o END) OVER (PARTITION BY path ORDER BY o, l) AS VARCHAR), 10, '0') AS invoice_key
FROM placed""")
def key_fill_forward_large(spark, sf):
    """S10 W1 at any size: a third of the orders lie in one file; its boundary keys are carried
    from task to task."""
    recs, _ = FW.read_fixed_width(FF.fixed_width_files(spark, sf), FF.FW_LAYOUTS)
    order = F.regexp_extract("path", r"(\d+)\.dat", 1).cast("long")
    rows = recs.select(F.when(order % 3 == 0, F.lit("fw/batch.dat")).otherwise(F.col("path")).alias("path"),
                       order.alias("source_order"), "line_no", "record_id", F.col("INV_HDR.invoice").alias("invoice"))
    filled = D.filled_forward(rows.withColumn("place", F.struct("source_order", "line_no")), F.col("record_id") == "INV_HDR",
                              F.col("invoice"), order_col="place", name="invoice_key")
    return filled.select("path", "source_order", "line_no", "record_id", "invoice_key")


# Two layouts that declare ``amount`` and ``flag`` differently.
MERGE_LAYOUTS = {"line": [("amount", "float"), ("flag", "string"), ("shipped", "date")],
                 "order": [("amount", "string"), ("flag", "boolean"), ("customer", "integer")]}


def _merge_frames(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("l_linenumber") % 2 == 0, "yes").otherwise(F.col("l_returnflag")).alias("flag"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.lit(0).alias("part"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("amount"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("no").alias("flag"), F.col("o_custkey").cast("string").alias("customer"))
    return {"line": lines, "order": orders}


@register("merge_layouts", """SELECT 'line' AS layout, l_orderkey AS key, l_linenumber AS part,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CASE WHEN l_linenumber % 2 = 0 THEN TRUE WHEN lower(l_returnflag) = 'n' THEN FALSE WHEN lower(l_returnflag) = 'y' THEN TRUE END AS flag,
  strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(NULL AS BIGINT) AS customer FROM lineitem
UNION ALL SELECT 'order', o_orderkey, 0, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END,
  CASE WHEN o_orderkey % 3 <> 0 THEN FALSE END, NULL, o_custkey FROM orders""")
def merge_layouts(spark, sf):
    """Frames of two layouts cast to their merged types and united."""
    return D.union_layouts(_merge_frames(spark, sf), MERGE_LAYOUTS, ["key", "part"])[0]


@register("merge_violations", """SELECT 'line' AS layout, l_orderkey AS key, l_linenumber AS part, 'flag' AS "column", l_returnflag AS value,
  'string' AS declared, 'boolean' AS merged FROM lineitem WHERE l_linenumber % 2 <> 0 AND lower(l_returnflag) NOT IN ('n', 'y')
UNION ALL SELECT 'order', o_orderkey, 0, 'amount', o_orderpriority, 'string', 'float' FROM orders WHERE o_orderkey % 2 <> 0""")
def merge_violations(spark, sf):
    """The texts that do not fit the merged type of their column."""
    return D.union_layouts(_merge_frames(spark, sf), MERGE_LAYOUTS, ["key", "part"])[1]
