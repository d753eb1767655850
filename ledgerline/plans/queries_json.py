"""Registered JSON queries: typed documents -> JSON text -> parsed back; split; golden diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import reconcile as RC
from ledgerline.operators.mapping import get_path
from ledgerline.plans import flatfiles as FF
from ledgerline.plans import invoices as I
from ledgerline.plans import oracle_invoices as OI
from ledgerline.plans.queries import register
from ledgerline.sources import delimited as D
from ledgerline.sources import fixedwidth as FW
from ledgerline.sources import jsondocs as J
from ledgerline.session import store

_LI = f"""li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(I.LINE_ORDER)}) - 1 AS line_no,
         count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem)"""


def _side(p: str) -> str:
    tgt = p == "t"
    drop = {"s": "o_orderkey % 13 <> 0", "t": "o_orderkey % 11 <> 0 OR o_orderkey % 13 = 0", "b": "TRUE"}[p]
    last = "AND NOT (l_orderkey % 19 = 0 AND line_no = n_lines - 1)" if tgt else ""
    qty = ("CAST(CASE WHEN l_partkey % 17 = 0 THEN CAST(l_quantity AS DECIMAL(18,2)) + 1 "
           "ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS DECIMAL(18,2))") if tgt else "CAST(l_quantity AS DECIMAL(18,2))"
    disc = ("CAST(CASE WHEN l_suppkey % 7 = 0 THEN CAST(l_discount AS DECIMAL(18,2)) + CAST(0.01 AS DECIMAL(18,2)) "
            "ELSE CAST(l_discount AS DECIMAL(18,2)) END AS DECIMAL(18,2))") if tgt else "CAST(l_discount AS DECIMAL(18,2))"
    total = ("CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2))"
             " + CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1.00 ELSE 0 END AS DECIMAL(18,2)) AS DECIMAL(18,2))") if tgt \
        else "CAST(o_totalprice AS DECIMAL(18,2))"
    status = "CASE WHEN o_orderkey % 23 <> 0 THEN o_orderstatus END" if tgt else "o_orderstatus"
    prio = "CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END" if tgt else "o_orderpriority"
    return f"""
{p}_jo AS (SELECT * FROM orders WHERE {drop}),
{p}_jl AS (SELECT 'inv_' || l_orderkey || '.json' AS doc, line_no, l_linenumber, l_partkey, l_suppkey,
                  CAST({qty} AS DOUBLE) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS extended_price,
                  CAST({disc} AS DOUBLE) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS tax,
                  l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, {qty} AS qd, l_orderkey
           FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM {p}_jo) {last}),
{p}_jh AS (SELECT 'inv_' || o_orderkey || '.json' AS doc, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
                  o_custkey AS customer, {status} AS status, {prio} AS priority, CAST({total} AS DOUBLE) AS total,
                  CAST(coalesce(n, 0) AS BIGINT) AS line_count, CAST(CAST(coalesce(q, 0) AS DECIMAL(18,2)) AS DOUBLE) AS total_quantity
           FROM {p}_jo LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(qd) AS q FROM {p}_jl GROUP BY l_orderkey)
             ON o_orderkey = l_orderkey),
{p}_leaf AS (
  SELECT doc, 'header.invoice_date' AS path, CASE WHEN invoice_date IS NULL THEN 'null' ELSE 'str' END AS type,
         invoice_date AS text, CAST(NULL AS DOUBLE) AS num FROM {p}_jh
  UNION ALL SELECT doc, 'header.customer', CASE WHEN customer IS NULL THEN 'null' ELSE 'int' END, NULL, CAST(customer AS DOUBLE) FROM {p}_jh
  UNION ALL SELECT doc, 'header.status', CASE WHEN status IS NULL THEN 'null' ELSE 'str' END, status, NULL FROM {p}_jh
  UNION ALL SELECT doc, 'header.priority', CASE WHEN priority IS NULL THEN 'null' ELSE 'str' END, priority, NULL FROM {p}_jh
  UNION ALL SELECT doc, 'header.total', 'float', NULL, total FROM {p}_jh
  UNION ALL SELECT doc, 'summary.line_count', 'int', NULL, CAST(line_count AS DOUBLE) FROM {p}_jh
  UNION ALL SELECT doc, 'summary.total_quantity', 'float', NULL, total_quantity FROM {p}_jh
  UNION ALL SELECT doc, 'lines[' || line_no || '].line_number', 'int', NULL, CAST(l_linenumber AS DOUBLE) FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].part', 'int', NULL, CAST(l_partkey AS DOUBLE) FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].supplier', 'int', NULL, CAST(l_suppkey AS DOUBLE) FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].quantity', 'float', NULL, quantity FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].extended_price', 'float', NULL, extended_price FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].discount', 'float', NULL, discount FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].tax', 'float', NULL, tax FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].return_flag', 'str', l_returnflag, NULL FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].line_status', 'str', l_linestatus, NULL FROM {p}_jl
  UNION ALL SELECT doc, 'lines[' || line_no || '].ship_date', 'str', ship_date, NULL FROM {p}_jl),
{p}_len AS (SELECT doc, 'lines' AS path, line_count AS n FROM {p}_jh)"""


@register("json_docs", f"WITH {_LI}," + _side("b") + """
SELECT 'book/' || h.doc AS path, CAST(regexp_extract(h.doc, 'inv_(\\d+)', 1) AS VARCHAR) AS invoice_number,
  f.l_partkey AS first_part, CAST(h.line_count AS INTEGER) AS n_lines, h.total AS total,
  h.line_count AS line_count, h.status AS status
FROM b_jh h LEFT JOIN (SELECT doc, l_partkey FROM b_jl WHERE line_no = 0) f USING (doc)""")
def json_docs(spark, sf):
    """Documents written as JSON text, read back with a declared schema, paths read."""
    text = J.to_json_docs(I.invoice_documents(spark, sf, "book"))
    docs, _ = J.read_json_docs(text, I.DOC_SCHEMA)
    return docs.select("path", get_path("doc.header.invoice_number").alias("invoice_number"),
                       get_path("doc.lines.0.part").alias("first_part"), F.size("doc.lines").alias("n_lines"),
                       F.col("doc.header.total").alias("total"), F.col("doc.summary.line_count").alias("line_count"),
                       F.col("doc.header.status").alias("status"))


@register("json_split", """SELECT * FROM (
  SELECT 'fw/inv_' || o_orderkey || '.dat' AS path, 'unknown' AS split_key, TRUE AS is_split_remainder,
         CAST(1 AS BIGINT) AS n_lines, CAST(NULL AS VARCHAR) AS match_value FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL
  SELECT 'fw/inv_' || o_orderkey || '.dat', lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), FALSE, 1 + coalesce(n, 0),
         lpad(CAST(o_orderkey AS VARCHAR), 10, '0')
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""")
def json_split(spark, sf):
    """Fixed-width records split by invoice; rows before the first invoice form the remainder."""
    recs, _ = FW.read_fixed_width(FF.fixed_width_files(spark, sf), FF.FW_LAYOUTS)
    inv = D.fill_forward_key(recs, F.col("record_id") == "INV_HDR", F.col("INV_HDR.invoice"))
    return J.split_summary(recs.withColumn("invoice", inv), "invoice")


@register("split_documents", """SELECT * FROM (
  SELECT 'fw/inv_' || o_orderkey || '.dat' AS path, 'unknown' AS split_key, TRUE AS is_split_remainder, 1 AS occ
  FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL
  SELECT 'fw/inv_' || o_orderkey || '.dat', lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), FALSE,
         unnest(range(1, CAST(2 + coalesce(n, 0) AS INTEGER)))::INT
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""")
def split_documents(spark, sf):
    """Every record with its document and its place in it."""
    recs, _ = FW.read_fixed_width(FF.fixed_width_files(spark, sf), FF.FW_LAYOUTS)
    inv = D.fill_forward_key(recs, F.col("record_id") == "INV_HDR", F.col("INV_HDR.invoice"))
    split = J.split_documents(recs.withColumn("invoice", inv), "invoice", order_col="line_no")
    return split.select("path", "split_key", "is_split_remainder", "occ")


@register("deep_diff", f"WITH {_LI}," + _side("s") + "," + _side("t") + """,
common_docs AS (SELECT doc FROM s_jh INTERSECT SELECT doc FROM t_jh),
lens AS (SELECT e.doc, e.path, e.n AS en, a.n AS an FROM s_len e JOIN t_len a USING (doc, path) WHERE e.n <> a.n),
e AS (SELECT * FROM s_leaf WHERE doc IN (SELECT doc FROM common_docs)),
a AS (SELECT * FROM t_leaf WHERE doc IN (SELECT doc FROM common_docs)),
j AS (SELECT coalesce(e.doc, a.doc) AS doc, coalesce(e.path, a.path) AS path, e.type AS e_type, a.type AS a_type,
             e.text AS etext, a.text AS atext, e.num AS enum, a.num AS anum
      FROM e FULL OUTER JOIN a ON e.doc = a.doc AND e.path = a.path),
k AS (SELECT *, CASE WHEN a_type IS NULL THEN 'missing' WHEN e_type IS NULL THEN 'unexpected'
        WHEN e_type = 'float' AND a_type = 'float' AND isnan(enum) AND isnan(anum) THEN NULL
        WHEN e_type = a_type AND e_type IN ('int', 'float') THEN CASE WHEN abs(anum - enum) >= 0.01 THEN 'value' END
        WHEN e_type IN ('int', 'float') AND a_type IN ('int', 'float') THEN CASE WHEN anum <> enum THEN 'value' END
        WHEN e_type <> a_type OR etext IS DISTINCT FROM atext THEN 'value' END AS kind
      FROM j WHERE NOT EXISTS (SELECT 1 FROM lens l WHERE l.doc = j.doc AND regexp_extract(j.path, '^([^\\[]*)\\[', 1) = l.path))
SELECT doc, path, kind, etext AS expected, atext AS actual, enum AS expected_num, anum AS actual_num FROM k WHERE kind IS NOT NULL
UNION ALL
SELECT doc, path, 'length', CAST(en AS VARCHAR), CAST(an AS VARCHAR), NULL, NULL FROM lens
UNION ALL SELECT doc, '', 'missing_document', NULL, NULL, NULL, NULL FROM s_jh WHERE doc NOT IN (SELECT doc FROM common_docs)
UNION ALL SELECT doc, '', 'unexpected_document', NULL, NULL, NULL, NULL FROM t_jh WHERE doc NOT IN (SELECT doc FROM common_docs)""")
def deep_diff(spark, sf):
    """Golden-style deep comparison of the source documents (expected) with the target ones (actual)."""
    def side(name):
        d = I.invoice_documents(spark, sf, name)
        return store(d.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_name"), "doc"))
    d = J.deep_diff(side("source"), side("target"), key="doc_name", doc_col="doc", skip={"invoice_number"})
    return d.withColumnRenamed("doc_name", "doc")


_DOUBLES = "('total', 'quantity', 'extended_price', 'discount', 'tax', 'total_quantity')"


def _as_text(p: str) -> str:
    """The fields of a side as the JSON text of its documents gives them; every fourth
    document is flat, and an absent status is a null."""
    key = "CAST(regexp_extract(doc_id, '(\\d+)\\.json', 1) AS BIGINT) % 4 = 0"
    value = f"CASE WHEN field IN {_DOUBLES} THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE value END"
    none = f"UNION ALL SELECT doc_id, 'header', 0, 'status', 'None', 3 FROM {p}_hdr WHERE status IS NULL"
    return f"""
{p}_j AS MATERIALIZED (
  SELECT doc_id, CASE WHEN {key} THEN 'flat' ELSE section END AS section, occ, field, {value} AS value, fpos
  FROM (SELECT * FROM {p}_f {none}) WHERE section = 'header' OR NOT ({key}))"""


def _text_diffs() -> str:
    diffs = OI.diff_ctes(I.profile_rules(1), suffix="_j")
    for p in "st":
        diffs = diffs.replace(f"FROM {p}_f f JOIN", f"FROM {p}_j f JOIN")
    return OI.materialized("WITH " + OI.INVOICE_CTES.strip() + "," + ",".join(map(_as_text, "st")) + diffs)


@register("json_text_diffs", _text_diffs() + "SELECT * FROM diffs_j")
def json_text_diffs(spark, sf):
    """JSON text of no declared schema -> records -> pairs -> diffs; a quarter of the
    documents are truly flat (section ``flat``), matched by a bare field."""
    sides = {}
    for side in ("source", "target"):
        docs = I.invoice_documents(spark, sf, side)
        key = F.regexp_extract("path", r"(\d+)\.json", 1).cast("long")
        text = F.when(key % 4 == 0, F.to_json("doc.header", {"ignoreNullFields": "false"})).otherwise(
            F.to_json("doc", {"ignoreNullFields": "false"}))
        records, _ = J.records_from_text(docs.select("path", text.alias("content")))
        records = store(records)
        bare = RC.PathKey().clean("invoice_number", "^INV-|")
        keys = RC.match_values_flat(records.where("section <> 'flat'"), I.MATCH_KEY).unionByName(
            RC.match_values_flat(records.where("section = 'flat'"), bare))
        sides[side] = records, keys
    (src, skeys), (tgt, tkeys) = sides["source"], sides["target"]
    return RC.diff_flat(spark, store(RC.pair_documents(skeys, tkeys)), src, tgt, I.profile_rules(1))
