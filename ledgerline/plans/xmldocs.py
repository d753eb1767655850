"""XML and cXML invoices rendered from the test tables (one file per order).

``xml/inv_<k>.xml``: namespace-prefixed root, a transmission header, one
invoice with header, nested special charge and one ``Item`` per line (line
number as attribute, nested ``ShipDetail``).  ``cxml/po_<k>.cxml``: an
``OrderRequest`` whose data sits in attributes, one ``OrderRequestLine`` per
line.  Values are the same decimal / ISO text as the other renderings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.invoices import numbered_lines
from ledgerline.session import spread, table

# Declared struct of the invoice XML.
INVOICE_XML_SCHEMA = (
    "TransmissionHeader struct<SenderID string, ReceiverID string, InvoiceCount int>, "
    "Invoice array<struct<Header struct<InvoiceNumber string, InvoiceDate string, Customer string, "
    "Priority string, Total double, SpecialCharge struct<ChargeType string, ChargeAmount double>>, "
    "Items struct<Item array<struct<_LineNumber int, ItemID string, Qty double, UnitPrice double, "
    "ShipDetail struct<ShipUOM string, ShipDate string>>>>>>")

CXML_HEADER_ATTRS = ["orderID", "orderDate", "orderTotal", "type", "currency"]
CXML_LINE_ATTRS = ["lineNumber", "quantity", "currency"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _dec(c: str) -> Column:
    return _s(F.col(c).cast("decimal(18,2)"))


def _per_order(spark: SparkSession, sf_dir: str, head: Column, line: Column, tail: Column, path: Column,
               which: Column | None = None) -> DataFrame:
    """One document per order; of ``which`` orders, if given."""
    o = table(spark, sf_dir, "orders")
    o = o if which is None else o.where(which)
    li = numbered_lines(spark, sf_dir)
    lines = (li.select(F.col("l_orderkey").alias("o_orderkey"), "line_no", line.alias("_t"))
               .groupBy("o_orderkey")
               .agg(F.array_sort(F.collect_list(F.struct("line_no", "_t"))).alias("_ls")))
    j = spread(o, "o_orderkey").join(lines, "o_orderkey", "left")
    body = F.coalesce(F.array_join(F.transform("_ls", lambda x: x["_t"]), ""), F.lit(""))
    return j.select(path.alias("path"), F.concat(head, body, tail).alias("content"))


def invoice_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _s(F.col("o_orderkey"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ns:Invoices xmlns:ns="urn:ledgerline:invoice">'
              "<TransmissionHeader><SenderID>LEDGERSRC</SenderID><ReceiverID>LEDGERTGT</ReceiverID>"
              "<InvoiceCount>1</InvoiceCount></TransmissionHeader><Invoice><Header><InvoiceNumber>"), k,
        F.lit("</InvoiceNumber><InvoiceDate>"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("</InvoiceDate><Customer>"), _s(F.col("o_custkey")), F.lit("</Customer><Priority>"),
        F.col("o_orderpriority"), F.lit("</Priority><Total>"), _dec("o_totalprice"),
        F.lit("</Total><SpecialCharge><ChargeType>FRT</ChargeType><ChargeAmount>"),
        _s((F.col("o_custkey").cast("decimal(18,2)") / 100).cast("decimal(18,2)")),
        F.lit("</ChargeAmount></SpecialCharge></Header><Items>"))
    line = F.concat(
        F.lit('<Item LineNumber="'), _s(F.col("line_no") + 1), F.lit('"><ItemID>'), _s(F.col("l_partkey")),
        F.lit("</ItemID><Qty>"), _dec("l_quantity"), F.lit("</Qty><UnitPrice>"), _dec("l_extendedprice"),
        F.lit("</UnitPrice><ShipDetail><ShipUOM>EA</ShipUOM><ShipDate>"), F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.lit("</ShipDate></ShipDetail></Item>"))
    tail = F.lit("</Items></Invoice></ns:Invoices>\n")
    return _per_order(spark, sf_dir, head, line, tail, F.concat(F.lit("xml/inv_"), k, F.lit(".xml")))


def cxml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _s(F.col("o_orderkey"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<cXML payloadID="'), k,
        F.lit('@ledgerline" timestamp="'), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00"),
        F.lit('"><Request><OrderRequest><OrderRequestHeader orderID="PO-'), k, F.lit('" orderDate="'),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('" orderTotal="'), _dec("o_totalprice"),
        F.lit('" type="new" currency="USD"><Total><Money currency="USD">'), _dec("o_totalprice"),
        F.lit("</Money></Total></OrderRequestHeader><OrderRequestDetail>"))
    line = F.concat(
        F.lit('<OrderRequestLine lineNumber="'), _s(F.col("line_no") + 1), F.lit('" quantity="'),
        _s(F.col("l_quantity").cast("bigint")), F.lit('" currency="USD"><ItemID><SupplierPartID>'),
        _s(F.col("l_partkey")), F.lit("</SupplierPartID></ItemID></OrderRequestLine>"))
    tail = F.lit("</OrderRequestDetail></OrderRequest></Request></cXML>\n")
    return _per_order(spark, sf_dir, head, line, tail, F.concat(F.lit("cxml/po_"), k, F.lit(".cxml")))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nested/`` documents whose data sits in attributes at several depths, by
    ``o_orderkey % 3``: a punch-out cXML message, a cXML order whose lines nest their
    currency, and a feed whose only lines are repeated second-level elements."""
    k, day = _s(F.col("o_orderkey")), F.date_format("o_orderdate", "yyyy-MM-dd")
    money = F.concat(F.lit('<Money currency="EUR" alternate="'), _dec("o_totalprice"), F.lit('"/>'))
    no = _s(F.col("line_no") + 1)
    part, price = _s(F.col("l_partkey")), _dec("l_extendedprice")
    punch = (F.concat(F.lit('<cXML payloadID="'), k, F.lit('"><Message><PunchOutOrderMessage><Header operation="create" currency="USD">'
                      "<Total>"), money, F.lit('</Total></Header>')),
             F.concat(F.lit('<ItemIn lineNumber="'), no, F.lit('" quantity="'), _s(F.col("l_quantity").cast("bigint")),
                      F.lit('"><ItemDetail currency="USD"><UnitPrice><Money currency="EUR">'), price,
                      F.lit("</Money></UnitPrice></ItemDetail></ItemIn>")),
             F.lit("</PunchOutOrderMessage></Message></cXML>"))
    order = (F.concat(F.lit('<cXML><Request><OrderRequest><OrderRequestHeader orderID="PO-'), k, F.lit('" orderDate="'), day,
                      F.lit('"><Total>'), money, F.lit("</Total></OrderRequestHeader><OrderRequestDetail>")),
             F.concat(F.lit("<OrderRequestLine><Quantity><Unit quantity=\""), _s(F.col("l_quantity").cast("bigint")),
                      F.lit('"/></Quantity><ItemID part="'), part, F.lit('" currency="GBP"/></OrderRequestLine>')),
             F.lit("</OrderRequestDetail></OrderRequest></Request></cXML>"))
    feed = (F.concat(F.lit('<Feed source="ledger"><Meta order="'), k, F.lit('"/>')),
            F.concat(F.lit('<row part="'), part, F.lit('"><q quantity="'), _s(F.col("l_quantity").cast("bigint")), F.lit('"/></row>')),
            F.lit("</Feed>"))
    out = None
    for i, (head, line, tail) in enumerate((punch, order, feed)):
        path = F.concat(F.lit("nested/"), k, F.lit(".xml"))
        docs = _per_order(spark, sf_dir, head, line, tail, path, F.col("o_orderkey") % 3 == i)
        out = docs if out is None else out.unionByName(docs)
    return out
