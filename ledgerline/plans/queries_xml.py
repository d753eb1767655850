"""Registered XML / cXML queries: render with Spark -> parse -> compare with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.plans import invoices as I
from ledgerline.plans import xmldocs as XD
from ledgerline.plans.queries import register
from ledgerline.sources import xml as XS

_LI = f"""WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(I.LINE_ORDER)}) - 1 AS line_no
  FROM lineitem)
"""


@register("xml_schema", _LI + """SELECT 'xml/inv_' || o_orderkey || '.xml' AS path,
  CAST(o_orderkey AS VARCHAR) AS InvoiceNumber, strftime(o_orderdate, '%Y-%m-%d') AS InvoiceDate,
  CAST(o_custkey AS VARCHAR) AS Customer, o_orderpriority AS Priority,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS Total,
  'FRT' AS "SpecialCharge.ChargeType", CAST(o_custkey AS DOUBLE) / 100 AS "SpecialCharge.ChargeAmount",
  CAST(line_no + 1 AS INTEGER) AS "@LineNumber", CAST(l_partkey AS VARCHAR) AS ItemID,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS Qty,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS UnitPrice,
  CASE WHEN l_orderkey IS NOT NULL THEN 'EA' END AS "ShipDetail.ShipUOM",
  strftime(l_shipdate, '%Y-%m-%d') AS "ShipDetail.ShipDate"
FROM orders LEFT JOIN li ON o_orderkey = l_orderkey""")
def xml_schema(spark, sf):
    """Schema-aware XML – one row per transaction line, nested fields as dot columns."""
    files = XD.invoice_xml_files(spark, sf)
    schema = T._parse_datatype_string(XD.INVOICE_XML_SCHEMA)
    inv_t = schema["Invoice"].dataType.elementType
    item_t = inv_t["Items"].dataType["Item"].dataType.elementType
    d = XS.parse_struct(files, XD.INVOICE_XML_SCHEMA)
    tx = d.select("path", F.explode("doc.Invoice").alias("inv"))
    rows = tx.select("path", "inv.Header", F.explode_outer("inv.Items.Item").alias("it"))
    return rows.select("path", *XS.flatten_struct(F.col("Header"), inv_t["Header"].dataType),
                       *XS.flatten_struct(F.col("it"), item_t))


_HDR = ", ".join(f'"header.@{a}"' for a in XD.CXML_HEADER_ATTRS)


@register("xml_cxml", _LI + """SELECT 'cxml/po_' || o_orderkey || '.cxml' AS path,
  'PO-' || o_orderkey AS "header.@orderID", strftime(o_orderdate, '%Y-%m-%d') AS "header.@orderDate",
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS "header.@orderTotal", 'new' AS "header.@type",
  'USD' AS "header.@currency", line_no AS line_index,
  CAST(line_no + 1 AS VARCHAR) AS "line.@lineNumber", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "line.@quantity",
  CASE WHEN l_orderkey IS NOT NULL THEN 'USD' END AS "line.@currency"
FROM orders LEFT JOIN li ON o_orderkey = l_orderkey""")
def xml_cxml(spark, sf):
    """cXML order requests – attributes only, header attributes on every line row."""
    return XS.cxml_attributes(XD.cxml_files(spark, sf), XD.CXML_HEADER_ATTRS, XD.CXML_LINE_ATTRS).drop("content")


@register("xml_generic", """SELECT path, line_element, n_lines, invoice_number FROM (
  SELECT 'xml/inv_' || o_orderkey || '.xml' AS path, CASE WHEN n > 0 THEN 'Item' END AS line_element,
         coalesce(n, 0) AS n_lines, CAST(o_orderkey AS VARCHAR) AS invoice_number
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  UNION ALL
  SELECT 'cxml/po_' || o_orderkey || '.cxml', NULL, 0, '' FROM orders)""")
def xml_generic(spark, sf):
    """Line-item discovery over generic XML (Item, Line, Detail, …) and a path read."""
    files = XD.invoice_xml_files(spark, sf).unionByName(XD.cxml_files(spark, sf))
    d = XS.discover_lines(files)
    inv = F.expr("xpath_string(content, '/*/Invoice/Header/InvoiceNumber')")
    return d.select("path", "line_element", "n_lines", inv.alias("invoice_number"))


@register("xml_nested_lines", _LI + """, rows AS (
  SELECT o_orderkey AS k, o_orderkey % 3 AS kind, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, line_no, CAST(l_partkey AS VARCHAR) AS part,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, count(l_orderkey) OVER (PARTITION BY o_orderkey) AS n
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)
SELECT DISTINCT 'nested/' || k || '.xml' AS path,
  CASE WHEN n = 0 OR (kind = 2 AND n = 1) THEN NULL WHEN kind = 0 THEN 'ItemIn' WHEN kind = 1 THEN 'OrderRequestLine' ELSE 'row' END AS line_element,
  CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' END AS header_currency,
  CASE WHEN kind < 2 THEN total END AS header_total, CASE kind WHEN 0 THEN 'create' END AS operation,
  CASE kind WHEN 1 THEN 'PO-' || k END AS order_id,
  CASE WHEN NOT (kind = 2 AND n = 1) THEN line_no END AS line_index,
  CASE WHEN n > 0 AND NOT (kind = 2 AND n = 1) THEN quantity END AS quantity,
  CASE WHEN kind > 0 AND NOT (kind = 2 AND n = 1) THEN part END AS part,
  CASE WHEN n > 0 THEN CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' END END AS currency
FROM rows""")
def xml_nested_lines(spark, sf):
    """Attributes at any depth, the last of a name staying; punch-out headers; lines
    found by tag or as repeated second-level elements."""
    found = XS.header_and_lines(XD.nested_files(spark, sf))
    header, line = F.col("header"), F.col("line")
    return found.select("path", "line_element", header["@currency"].alias("header_currency"), header["@alternate"].alias("header_total"),
                        header["@operation"].alias("operation"), header["@orderID"].alias("order_id"), "line_index",
                        line["@quantity"].alias("quantity"), line["@part"].alias("part"), line["@currency"].alias("currency"))
