"""Registered X12 queries: render -> tokenise -> transactions -> keys / map / diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.carry import Fold, in_order, running
from ledgerline.functions.packing import pack, unpack
from ledgerline.operators import mapping as M
from ledgerline.operators import reconcile as RC
from ledgerline.plans import oracle_x12 as OX
from ledgerline.plans import x12docs as X
from ledgerline.plans.queries import register
from ledgerline.sources import x12 as XS

_SEG = OX.segments_sql()


def _all_transactions(spark, sf):
    return X.parsed_transactions(spark, sf, "source").unionByName(X.parsed_transactions(spark, sf, "target"))


def _all_segments(spark, sf):
    out = None
    for side in ("source", "target"):
        segs, _ = XS.parse(X.interchange_files(spark, sf, side))
        segs = segs.withColumn("side", F.lit(side))
        out = segs if out is None else out.unionByName(segs)
    return out


@register("x12_segments", _SEG + """SELECT side, doc_id, seg_pos, segment, len(elements) AS n_elements,
  array_to_string(elements, '|') AS elements_text
FROM (SELECT 'source' AS side, * FROM sx_seg UNION ALL SELECT 'target', * FROM tx_seg)""")
def x12_segments(spark, sf):
    """Every segment of every interchange, tokenised from text."""
    return _all_segments(spark, sf).select(
        "side", "doc_id", "seg_pos", "segment", F.size("elements").alias("n_elements"),
        F.array_join("elements", "|").alias("elements_text"))


@register("x12_transactions", _SEG + """SELECT doc_id, 0 AS tx_index, count(*) AS n_segments,
  min(seg_pos) AS first_pos, max(seg_pos) AS last_pos,
  max(CASE WHEN segment = 'ST' THEN elements[2] END) AS transaction_type
FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg)
WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA') GROUP BY doc_id""")
def x12_transactions(spark, sf):
    """ST/SE loops per file with their transaction type."""
    tx = _all_transactions(spark, sf)
    return (tx.groupBy("doc_id", "tx_index")
              .agg(F.count(F.lit(1)).alias("n_segments"), F.min("seg_pos").alias("first_pos"),
                   F.max("seg_pos").alias("last_pos"),
                   F.max(F.when(F.col("segment") == "ST", F.get(F.col("elements"), 1))).alias("transaction_type")))


@register("x12_large_transactions", _SEG + """,
one AS (SELECT CASE WHEN o % 3 = 0 THEN 'batch.edi' ELSE doc_id END AS file, o, seg_pos, segment, elements
        FROM (SELECT *, CAST(regexp_extract(doc_id, '(\\d+)\\.edi', 1) AS BIGINT) AS o FROM bx_seg)),
tx AS (SELECT file, o, row_number() OVER (PARTITION BY file ORDER BY o, seg_pos) - 1 AS pos, segment, elements FROM one),
loops AS (SELECT file, o, count(*) FILTER (segment NOT IN ('ISA', 'GS', 'GE', 'IEA')) AS n_segments,
                 min(pos) FILTER (segment = 'ST') AS first_pos, max(pos) FILTER (segment = 'SE') AS last_pos,
                 max(CASE WHEN segment = 'BIG' THEN elements[3] END) AS invoice FROM tx GROUP BY file, o)
SELECT file AS doc_id, row_number() OVER (PARTITION BY file ORDER BY o) - 1 AS tx_index, n_segments, first_pos, last_pos,
  invoice FROM loops""")
def x12_large_transactions(spark, sf):
    """S11 S13 W2 at any size: the interchanges of a third of the orders as one file of many
    transactions, loops found by values carried from task to task."""
    segs, _ = XS.parse(X.interchange_files(spark, sf, "book"))
    order = F.regexp_extract("doc_id", r"(\d+)\.edi", 1).cast("long")
    one = segs.select(F.when(order % 3 == 0, F.lit("batch.edi")).otherwise(F.col("doc_id")).alias("doc_id"),
                      order.alias("_o"), "seg_pos", "segment",  # of other segments no element is read
                      F.when(F.col("segment") == "BIG", pack(F.col("elements"))).alias("elements"))
    placed = in_order(one, "doc_id", "_o", "seg_pos", keep=["doc_id", "segment", "elements"])
    numbered = running(placed, ["doc_id"], n=Fold("count"), _st=XS.sts()).withColumn("seg_pos", F.col("n") - 1).drop("n")
    tx = XS.transactions_of_large(numbered)
    return tx.groupBy("doc_id", "tx_index").agg(
        F.count(F.lit(1)).alias("n_segments"), F.min("seg_pos").alias("first_pos"), F.max("seg_pos").alias("last_pos"),
        F.max(F.when(F.col("segment") == "BIG", F.get(unpack(F.col("elements")), 2))).alias("invoice"))


@register("x12_segment_profile", _SEG + """SELECT side, segment, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT 'source' AS side, * FROM sx_seg UNION ALL SELECT 'target', * FROM tx_seg) GROUP BY side, segment""")
def x12_segment_profile(spark, sf):
    """Segment inventory of the interchanges."""
    s = _all_segments(spark, sf)
    per_doc = XS.segment_profile(s.drop("side").withColumn("doc_id", F.col("doc_id")))
    side = F.substring_index("doc_id", "/", 1)
    return (per_doc.groupBy(side.alias("side"), "segment")
                   .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")))


_REQ = [s for s, lo, _ in X.SPEC_810 if lo > 0]
_MAX = [(s, hi) for s, _, hi in X.SPEC_810 if hi is not None]


@register("x12_cardinality", _SEG + f""",
tx AS (SELECT * FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg) WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA')),
cnt AS (SELECT doc_id, segment, count(*) AS n FROM tx GROUP BY doc_id, segment),
docs AS (SELECT DISTINCT doc_id FROM tx),
req AS (SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in _REQ)}) t(segment)),
mx AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {hi})" for s, hi in _MAX)}) t(segment, max_use))
SELECT doc_id, 0 AS tx_index, segment, n, 'too_many' AS violation FROM cnt JOIN mx USING (segment) WHERE n > max_use
UNION ALL
SELECT d.doc_id, 0, r.segment, 0, 'missing_required' FROM docs d, req r
WHERE NOT EXISTS (SELECT 1 FROM cnt c WHERE c.doc_id = d.doc_id AND c.segment = r.segment)""")
def x12_cardinality(spark, sf):
    """Required segments and maximum use per transaction."""
    tx = _all_transactions(spark, sf)
    return XS.cardinality_violations(spark, tx, X.SPEC_810)


_DIFFS = OX.diffs_sql()


@register("x12_diffs", _DIFFS + "SELECT * FROM diffs")
def x12_diffs(spark, sf):
    """Segment-aligned diffs of the X12 invoices."""
    return X.x12_run(spark, sf)[1]


@register("x12_pairs_status", _DIFFS + """SELECT p.pair_id, p.match_value, p.source_file, p.target_file,
  CASE WHEN source_file IS NULL OR target_file IS NULL THEN 'UNMATCHED' WHEN coalesce(d.n, 0) > 0 THEN 'MISMATCH'
       ELSE 'MATCH' END AS status,
  CASE WHEN source_file IS NULL OR target_file IS NULL THEN 0 ELSE coalesce(d.n, 0) END AS diff_count
FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM diffs GROUP BY pair_id) d USING (pair_id)""")
def x12_pairs_status(spark, sf):
    """J6 J7 C2 C25 on X12: pairs by BIG02 (normalised) with status."""
    pairs, diffs = X.x12_run(spark, sf)
    return RC.pair_status(pairs, diffs).select("pair_id", "match_value", "source_file", "target_file",
                                               "status", "diff_count")


@register("match_keys_composite", _SEG + """SELECT side, doc_id, 0 AS tx_index, b || chr(31) || n AS match_value FROM (
  SELECT side, doc_id,
    arg_min(CASE WHEN segment = 'BIG' AND coalesce(elements[5], '') <> '' THEN elements[5] END,
            CASE WHEN segment = 'BIG' AND coalesce(elements[5], '') <> '' THEN seg_pos END) AS b,
    arg_min(CASE WHEN segment = 'N1' AND coalesce(elements[5], '') <> '' THEN elements[5] END,
            CASE WHEN segment = 'N1' AND coalesce(elements[5], '') <> '' THEN seg_pos END) AS n
  FROM (SELECT 'source' AS side, * FROM sx_seg UNION ALL SELECT 'target', * FROM tx_seg)
  WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA') GROUP BY side, doc_id) WHERE b IS NOT NULL AND n IS NOT NULL""")
def match_keys_composite(spark, sf):
    """Composite X12 key BIG04 + N104 (strict AND), unit-separator joined."""
    out = None
    for side in ("source", "target"):
        k = RC.match_values_x12(X.parsed_transactions(spark, sf, side), X.COMPOSITE_KEY).withColumn("side", F.lit(side))
        out = k if out is None else out.unionByName(k)
    return out.select("side", "doc_id", "tx_index", "match_value")


# The 810 map used by ``x12_map_810``.
MAP_810 = {
    "header": {
        "invoice_number": {"source": "BIG.02", "transform": "strip"},
        "invoice_date": {"source": "BIG.01", "transform": {"name": "to_date", "format": "%Y%m%d"}},
        "po_number": "BIG.04",
        "buyer": {"source": "N1.02", "transform": "upper"},
        "customer": {"source": "N1.04", "transform": "to_int"},
        "ship_date": {"source": "DTM.02", "default": "unknown"},
    },
    "lines": [{
        "line": {"source": "IT1.01", "transform": "to_int"},
        "quantity": {"source": "IT1.02", "transform": "to_float"},
        "unit": "IT1.03",
        "price": {"source": "IT1.04", "transform": "to_float"},
        "part": "IT1.07",
    }],
    "summary": {
        "total_cents": {"source": "TDS.01", "transform": "to_int"},
        "line_count": {"source": "CTT.01", "transform": "to_int"},
    },
}


@register("x12_map_810", _SEG + """, tx AS (SELECT * FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg)
  WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA')),
f AS (SELECT doc_id,
  arg_min(CASE WHEN segment = 'ST' THEN elements[2] END, CASE WHEN segment = 'ST' THEN seg_pos END) AS transaction_type,
  arg_min(CASE WHEN segment = 'BIG' THEN elements[3] END, CASE WHEN segment = 'BIG' THEN seg_pos END) AS inv,
  arg_min(CASE WHEN segment = 'BIG' THEN elements[2] END, CASE WHEN segment = 'BIG' THEN seg_pos END) AS d,
  arg_min(CASE WHEN segment = 'BIG' THEN elements[5] END, CASE WHEN segment = 'BIG' THEN seg_pos END) AS po,
  arg_min(CASE WHEN segment = 'N1' THEN elements[3] END, CASE WHEN segment = 'N1' THEN seg_pos END) AS buyer,
  arg_min(CASE WHEN segment = 'N1' THEN elements[5] END, CASE WHEN segment = 'N1' THEN seg_pos END) AS cust,
  arg_min(CASE WHEN segment = 'DTM' THEN elements[3] END, CASE WHEN segment = 'DTM' THEN seg_pos END) AS ship,
  arg_min(CASE WHEN segment = 'TDS' THEN elements[2] END, CASE WHEN segment = 'TDS' THEN seg_pos END) AS tds,
  arg_min(CASE WHEN segment = 'CTT' THEN elements[2] END, CASE WHEN segment = 'CTT' THEN seg_pos END) AS ctt
  FROM tx GROUP BY doc_id)
SELECT doc_id, 0 AS tx_index, transaction_type,
  trim(inv, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)) AS header__invoice_number,
  strftime(try_strptime(d, '%Y%m%d'), '%Y-%m-%d') AS header__invoice_date,
  po AS header__po_number, upper(buyer) AS header__buyer,
  CAST(TRY_CAST(cust AS DOUBLE) AS BIGINT) AS header__customer,
  coalesce(ship, 'unknown') AS header__ship_date,
  CAST(TRY_CAST(tds AS DOUBLE) AS BIGINT) AS summary__total_cents,
  CAST(TRY_CAST(ctt AS DOUBLE) AS BIGINT) AS summary__line_count
FROM f""")
def x12_map_810(spark, sf):
    """X12 transactions mapped to header + summary."""
    tx = _all_transactions(spark, sf)
    docs, _ = M.map_x12(tx, MAP_810)
    return docs


@register("x12_map_810_lines", _SEG + """SELECT doc_id, 0 AS tx_index, CAST(elements[2] AS BIGINT) - 1 AS line_no,
  CAST(TRY_CAST(elements[2] AS DOUBLE) AS BIGINT) AS line, TRY_CAST(elements[3] AS DOUBLE) AS quantity,
  elements[4] AS unit, TRY_CAST(elements[5] AS DOUBLE) AS price, elements[8] AS part
FROM (SELECT * FROM sx_seg UNION ALL SELECT * FROM tx_seg) WHERE segment = 'IT1'""")
def x12_map_810_lines(spark, sf):
    """One mapped line per IT1 segment."""
    tx = _all_transactions(spark, sf)
    _, lines = M.map_x12(tx, MAP_810)
    return lines


@register("registry_route", OX.routed_sql() + "SELECT doc_id, tx_index, transaction_type, map, unmapped, doc FROM docs")
def registry_route(spark, sf):
    """Each transaction mapped by the map of its own type, the default map for unknown types."""
    tx, _ = XS.parse_transactions(X.mixed_files(spark, sf))
    return M.map_routed(tx, X.REGISTRY, "810", X.LINE_SEGMENTS)[0]


@register("registry_route_lines", OX.routed_sql() + "SELECT doc_id, tx_index, line_no, map, line FROM doc_lines")
def registry_route_lines(spark, sf):
    """The lines of routed transactions, by the line segment of their type."""
    tx, _ = XS.parse_transactions(X.mixed_files(spark, sf))
    return M.map_routed(tx, X.REGISTRY, "810", X.LINE_SEGMENTS)[1]
