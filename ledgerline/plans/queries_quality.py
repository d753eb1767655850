"""Registered transform / quality queries over the test tables and their renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import transforms as TF
from ledgerline.operators import mapping as M
from ledgerline.operators import quality as Q
from ledgerline.plans import flatfiles as FF
from ledgerline.plans import oracle_x12 as OX
from ledgerline.plans import x12docs as X
from ledgerline.plans.queries import register
from ledgerline.plans.queries_x12 import MAP_810
from ledgerline.session import table
from ledgerline.sources import delimited as D


@register("map_transforms", """SELECT l_orderkey, l_linenumber,
  format('{:,.2f}', l_extendedprice) AS amount_text,
  CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE) AS to_float,
  CAST(trunc(CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE)) AS BIGINT) AS to_int,
  strftime(l_shipdate, '%Y-%m-%d') AS to_date, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS to_datetime,
  l_returnflag AS strip, upper(l_linestatus) AS upper, lower(l_returnflag) AS lower,
  coalesce(nullif(l_linestatus, 'O'), 'OPEN') AS "default",
  substr(CAST(l_partkey AS VARCHAR), least(1, length(CAST(l_partkey AS VARCHAR))) + 1,
         greatest(greatest(length(CAST(l_partkey AS VARCHAR)) - 1, 0) - least(1, length(CAST(l_partkey AS VARCHAR))), 0)) AS substring,
  replace(strftime(l_shipdate, '%Y-%m-%d'), '-', '/') AS replace,
  CAST(l_linenumber AS VARCHAR) AS to_string,
  CASE WHEN l_linestatus = 'F' THEN 'n/a' ELSE lower(l_linestatus) END AS mapped_status
FROM lineitem""")
def map_transforms(spark, sf):
    """Every built-in transform through the registry, on every lineitem row."""
    li = table(spark, sf, "lineitem")
    amount = F.format_number("l_extendedprice", 2)
    t = TF.apply_transform
    return li.select(
        "l_orderkey", "l_linenumber", amount.alias("amount_text"),
        t(amount, "to_float").alias("to_float"), t(amount, "to_int").alias("to_int"),
        t(F.date_format("l_shipdate", "M/d/yyyy"), "to_date").alias("to_date"),
        t(F.date_format("l_shipdate", "M/d/yyyy HH:mm:ss"), "to_datetime").alias("to_datetime"),
        t(F.concat(F.lit("  "), F.col("l_returnflag"), F.lit("\t")), "strip").alias("strip"),
        t(F.lower("l_linestatus"), "upper").alias("upper"), t(F.col("l_returnflag"), "lower").alias("lower"),
        t(F.nullif(F.col("l_linestatus"), F.lit("O")), {"name": "default", "default_value": "OPEN"}).alias("default"),
        t(F.col("l_partkey").cast("string"), {"name": "substring", "start": 1, "end": -1}).alias("substring"),
        t(F.date_format("l_shipdate", "yyyy-MM-dd"), {"name": "replace", "pattern": "-", "replacement": "/"}).alias("replace"),
        t(F.col("l_linenumber"), "to_string").alias("to_string"),
        M.map_field(F.nullif(F.col("l_linestatus"), F.lit("F")), {"transform": "lower", "default": "n/a"})
         .alias("mapped_status"))


# Declared types and required flags of the DTL record.
DTL_RULES = [("line", "integer", True), ("part", "integer", True), ("quantity", "float", True),
             ("price", "float", True), ("flag", "string", True)]


@register("row_conformance", f"""WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS line_no FROM lineitem)
SELECT 'mr/inv_' || l_orderkey || '.txt' AS path, line_no + CASE WHEN l_orderkey % 10 = 0 THEN 2 ELSE 1 END AS line_no,
  CASE WHEN l_partkey % 4 = 0 AND l_suppkey % 5 <> 0 THEN 'flag: required' ELSE '' END AS errors,
  NOT (l_partkey % 4 = 0 AND l_suppkey % 5 <> 0) AS conforms
FROM li""")
def row_conformance(spark, sf):
    """Required and type checks per DTL record; bad rows are flagged, not fatal to the file."""
    recs, _ = D.read_multirecord(FF.multirecord_files(spark, sf), FF.MR_RECORDS, "|")
    dtl = recs.filter(F.col("record_id") == "DTL")
    cols = {n: F.col("fields")[n] for n, _, _ in DTL_RULES}
    checked = Q.conformance(dtl, DTL_RULES, raw=cols)
    return checked.select("path", "line_no", F.array_join("errors", ";").alias("errors"), "conforms")


def _map_sources(spec: dict) -> list[str]:
    out = []
    for section in ("header", "summary"):
        for target, rule in spec.get(section, {}).items():
            out.append(rule if isinstance(rule, str) else rule.get("source", target))
    for rs in spec.get("lines", []):
        for target, rule in rs.items():
            out.append(rule if isinstance(rule, str) else rule.get("source", target))
    return out


_MAPPED = ", ".join(f"('{s}')" for s in sorted(set(_map_sources(MAP_810))))


@register("coverage", OX.segments_sql() + f""",
seen AS (
  SELECT segment || '.' || lpad(CAST(i AS VARCHAR), 2, '0') AS source_field, count(DISTINCT doc_id) AS n_docs
  FROM bx_seg, LATERAL (SELECT unnest(range(1, len(elements))) AS i)
  WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA') AND coalesce(elements[i + 1], '') <> ''
  GROUP BY 1)
SELECT source_field, n_docs, source_field IN (SELECT * FROM (VALUES {_MAPPED}) t(s)) AS mapped FROM seen""")
def coverage(spark, sf):
    """Source fields present in the X12 invoices, documents using them, and whether the 810 map reads them."""
    tx = X.parsed_transactions(spark, sf, "book")
    ex = tx.select("doc_id", "segment", F.posexplode(F.slice("elements", 2, F.greatest(F.size("elements") - 1, F.lit(0))))
                   .alias("i", "v")).filter(F.col("v") != "")
    fields = ex.select("doc_id", F.concat("segment", F.lit("."), F.lpad((F.col("i") + 1).cast("string"), 2, "0"))
                       .alias("source_field"))
    return Q.coverage(fields, _map_sources(MAP_810), spark)


@register("field_trace", OX.segments_sql() + """
SELECT doc_id, 0 AS tx_index, line_no, field, value FROM (
  SELECT doc_id, CAST(elements[2] AS BIGINT) - 1 AS line_no, CAST(CAST(elements[2] AS BIGINT) AS VARCHAR) AS line,
         CAST(CAST(elements[3] AS DECIMAL(18,2)) AS VARCHAR) AS quantity, elements[4] AS unit, elements[8] AS part
  FROM bx_seg WHERE segment = 'IT1')
UNPIVOT (value FOR field IN (line, quantity, unit, part)) WHERE line_no < 3""")
def field_trace(spark, sf):
    """Source -> target trace of the first three mapped lines of every X12 invoice."""
    _, lines = M.map_x12(X.parsed_transactions(spark, sf, "book"), MAP_810)
    lines = lines.withColumn("quantity", F.col("quantity").cast("decimal(18,2)"))
    return Q.field_trace(lines, ["doc_id", "tx_index"], "line_no", ["line", "quantity", "unit", "part"], 3)


# Targets of the coverage report; no invoice has a REF segment.
COVERED = {"header": {"invoice_number": "BIG.02", "ship_date": "DTM.02", "reference": "REF.02"}, "summary": {"total_cents": "TDS.01"}}
_COVERED = OX.segments_sql() + """, tx AS (SELECT * FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg)),
d AS (SELECT doc_id, count(*) FILTER (segment = 'BIG' AND elements[3] <> '') AS a, count(*) FILTER (segment = 'DTM' AND elements[3] <> '') AS b,
             count(*) FILTER (segment = 'TDS' AND elements[2] <> '') AS c FROM tx GROUP BY doc_id),
s AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS a, count(*) FILTER (b > 0) AS b, count(*) FILTER (c > 0) AS c FROM d),
t AS (SELECT unnest([{'f': 'header__invoice_number', 'v': a}, {'f': 'header__ship_date', 'v': b}, {'f': 'header__reference', 'v': 0},
                     {'f': 'summary__total_cents', 'v': c}]) AS x, n FROM s)
"""


def _covered(spark, sf):
    tx = X.parsed_transactions(spark, sf, "source").unionByName(X.parsed_transactions(spark, sf, "target"))
    docs, _ = M.map_x12(tx, COVERED)
    return docs, [c for c in docs.columns if "__" in c]


@register("coverage_targets", _COVERED + """SELECT x.f AS target_field, x.v AS n_populated, n AS n_rows,
  round(x.v * 100.0::DOUBLE / n, 2) AS pct FROM t""")
def coverage_targets(spark, sf):
    """How many documents populate each mapped target, and the share."""
    return Q.populated(*_covered(spark, sf))


@register("empty_targets", _COVERED + "SELECT x.f AS target_field, n AS n_rows FROM t WHERE x.v = 0")
def empty_targets(spark, sf):
    """Mapped targets that no document populates."""
    return Q.empty_targets(*_covered(spark, sf))


@register("mapping_trace", """WITH r AS (
  SELECT o_orderkey, 0 AS row_no, CAST(o_custkey AS VARCHAR) AS cust, o_orderpriority AS prio, o_orderstatus AS st FROM orders)
SELECT o_orderkey, row_no, 'cust' AS source_path, cust AS source_value, 'customer' AS target_field, cust AS target_value, TRUE AS mapped FROM r
UNION ALL SELECT o_orderkey, row_no, 'prio', prio, 'priority', lower(prio), TRUE FROM r
UNION ALL SELECT o_orderkey, row_no, 'gone', NULL, 'note', 'none', TRUE FROM r
UNION ALL SELECT o_orderkey, row_no, 'st', st, NULL, NULL, FALSE FROM r""")
def mapping_trace(spark, sf):
    """Source path and text, target and value of every rule, and the columns that none reads."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("row_no"), F.col("o_custkey").cast("string").alias("cust"),
                                             F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("st"))
    rules = {"customer": {"source": "cust", "transform": "to_int"}, "priority": {"source": "prio", "transform": "lower"},
             "note": {"source": "gone", "default": "none"}}
    return Q.mapping_trace(rows, ["o_orderkey"], "row_no", rules)
