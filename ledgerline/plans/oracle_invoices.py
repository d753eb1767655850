"""DuckDB SQL oracle for the invoice reconciliation plans.

The SQL computes the same results from the base tables in long form (one
row per field, UNPIVOT) with plain joins – a deliberately different shape from
the Spark plan, which aligns whole records and zips their fields.
"""

from __future__ import annotations

import re

from ledgerline.functions.transforms import NUMERIC_PATTERN
from ledgerline.operators import rules as R
from ledgerline.plans import invoices as I


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(float(v)) if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def materialized(sql: str) -> str:
    """Each named table of ``sql`` computed once, however often it is read."""
    return re.sub(r"\b(\w+) AS \((?=\s*(?:SELECT|WITH)\b)", r"\1 AS MATERIALIZED (", sql)


def rules_values(book: R.RuleBook, crosswalk: list[dict] | None = None) -> str:
    columns = ["tier_rank", "tier", "segment", "field", *R.RULE_ATTRS]
    rows = [[r[c] for c in columns] for r in book.rows(crosswalk)]
    body = ",\n    ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows)
    return (f"SELECT * FROM (VALUES\n    {body}) AS t(tier_rank, tier, segment, field, severity, ignore_case, "
            f"numeric, conditional_qualifier, amount_variance)")


def ignores_values(book: R.RuleBook) -> str:
    rows = [(s, f) for _, s, f in book.ignored]
    if not rows:
        return "SELECT CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS field WHERE FALSE"
    body = ", ".join(f"({_q(s)}, {_q(f)})" for s, f in rows)
    return f"SELECT DISTINCT * FROM (VALUES {body}) AS t(segment, field)"


def merged_rules_sql(book: R.RuleBook, crosswalk: list[dict] | None = None) -> str:
    """The whole rule of the highest tier; a crosswalk row overlays what it sets."""
    tables = f"""t AS ({rules_values(book, crosswalk)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY segment, field ORDER BY tier_rank DESC) AS place
                 FROM t WHERE tier <> 'crosswalk'),
      best AS (SELECT * FROM ranked WHERE place = 1), x AS (SELECT * FROM t WHERE tier = 'crosswalk')"""
    attrs = ", ".join(f"coalesce(x.{a}, best.{a}) AS {a}" for a in R.RULE_ATTRS)
    return (f"WITH {tables} SELECT segment, field, coalesce(x.tier, best.tier) AS tier, {attrs} "
            f"FROM best FULL OUTER JOIN x USING (segment, field)")


def _fpos(fields: list[str]) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fields)) + " END"


INVOICE_CTES = f"""
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(I.LINE_ORDER)}) - 1 AS line_no,
         count(*) OVER (PARTITION BY l_orderkey) AS n_lines
  FROM lineitem),
s_o AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0),
t_o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 13 = 0),
s_l AS (
  SELECT li.*, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_discount AS DECIMAL(18,2)) AS disc
  FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM s_o)),
t_l AS (
  SELECT li.*,
    CAST(CASE WHEN l_partkey % 17 = 0 THEN CAST(l_quantity AS DECIMAL(18,2)) + 1 ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS qty,
    CAST(CASE WHEN l_suppkey % 7 = 0 THEN CAST(l_discount AS DECIMAL(18,2)) + CAST(0.01 AS DECIMAL(18,2)) ELSE CAST(l_discount AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS disc
  FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM t_o)
    AND NOT (l_orderkey % 19 = 0 AND line_no = n_lines - 1)),
s_sum AS (SELECT l_orderkey, count(*) AS n, sum(qty) AS q FROM s_l GROUP BY l_orderkey),
t_sum AS (SELECT l_orderkey, count(*) AS n, sum(qty) AS q FROM t_l GROUP BY l_orderkey),
s_hdr AS (
  SELECT 'source/inv_' || o_orderkey || '.json' AS doc_id, o_orderkey,
    CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
    CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_orderpriority AS priority,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
    CAST(coalesce(n, 0) AS VARCHAR) AS line_count,
    CAST(CAST(coalesce(q, 0) AS DECIMAL(18,2)) AS VARCHAR) AS total_quantity
  FROM s_o LEFT JOIN s_sum ON o_orderkey = l_orderkey),
t_hdr AS (
  SELECT 'target/inv_' || o_orderkey || '.json' AS doc_id, o_orderkey,
    'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
    CAST(o_custkey AS VARCHAR) AS customer,
    CASE WHEN o_orderkey % 23 <> 0 THEN o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
    CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2))
      + CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2))
      + CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1.00 ELSE 0 END AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR) AS total,
    CAST(coalesce(n, 0) AS VARCHAR) AS line_count,
    CAST(CAST(coalesce(q, 0) AS DECIMAL(18,2)) AS VARCHAR) AS total_quantity
  FROM t_o LEFT JOIN t_sum ON o_orderkey = l_orderkey),
s_ln AS (
  SELECT 'source/inv_' || l_orderkey || '.json' AS doc_id, line_no,
    CAST(l_linenumber AS VARCHAR) AS line_number, CAST(l_partkey AS VARCHAR) AS part,
    CAST(l_suppkey AS VARCHAR) AS supplier, CAST(qty AS VARCHAR) AS quantity,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS extended_price,
    CAST(disc AS VARCHAR) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax,
    l_returnflag AS return_flag, l_linestatus AS line_status, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
  FROM s_l),
t_ln AS (
  SELECT 'target/inv_' || l_orderkey || '.json' AS doc_id, line_no,
    CAST(l_linenumber AS VARCHAR) AS line_number, CAST(l_partkey AS VARCHAR) AS part,
    CAST(l_suppkey AS VARCHAR) AS supplier, CAST(qty AS VARCHAR) AS quantity,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS extended_price,
    CAST(disc AS VARCHAR) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax,
    l_returnflag AS return_flag, l_linestatus AS line_status, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
  FROM t_l),
s_f AS (
  SELECT doc_id, 'header' AS section, 0 AS occ, field, value, {_fpos(I.HEADER_FIELDS)} AS fpos FROM
    (SELECT doc_id, {", ".join(I.HEADER_FIELDS)} FROM s_hdr) UNPIVOT (value FOR field IN ({", ".join(I.HEADER_FIELDS)}))
  UNION ALL
  SELECT doc_id, 'summary', 0, field, value, {_fpos(I.SUMMARY_FIELDS)} FROM
    (SELECT doc_id, {", ".join(I.SUMMARY_FIELDS)} FROM s_hdr) UNPIVOT (value FOR field IN ({", ".join(I.SUMMARY_FIELDS)}))
  UNION ALL
  SELECT doc_id, 'line', line_no, field, value, {_fpos(I.LINE_FIELDS)} FROM
    s_ln UNPIVOT (value FOR field IN ({", ".join(I.LINE_FIELDS)}))),
t_f AS (
  SELECT doc_id, 'header' AS section, 0 AS occ, field, value, {_fpos(I.HEADER_FIELDS)} AS fpos FROM
    (SELECT doc_id, {", ".join(I.HEADER_FIELDS)} FROM t_hdr) UNPIVOT (value FOR field IN ({", ".join(I.HEADER_FIELDS)}))
  UNION ALL
  SELECT doc_id, 'summary', 0, field, value, {_fpos(I.SUMMARY_FIELDS)} FROM
    (SELECT doc_id, {", ".join(I.SUMMARY_FIELDS)} FROM t_hdr) UNPIVOT (value FOR field IN ({", ".join(I.SUMMARY_FIELDS)}))
  UNION ALL
  SELECT doc_id, 'line', line_no, field, value, {_fpos(I.LINE_FIELDS)} FROM
    t_ln UNPIVOT (value FOR field IN ({", ".join(I.LINE_FIELDS)}))),
s_k AS (SELECT doc_id, regexp_replace(value, '^INV-', '') AS match_value FROM s_f
        WHERE section = 'header' AND field = 'invoice_number' AND value <> ''),
t_k AS (SELECT doc_id, regexp_replace(value, '^INV-', '') AS match_value FROM t_f
        WHERE section = 'header' AND field = 'invoice_number' AND value <> ''),
s_n AS (SELECT match_value, row_number() OVER (PARTITION BY match_value ORDER BY doc_id) AS occ, doc_id AS source_file FROM s_k),
t_n AS (SELECT match_value, row_number() OVER (PARTITION BY match_value ORDER BY doc_id) AS occ, doc_id AS target_file FROM t_k),
pairs AS (
  SELECT coalesce(s.match_value, t.match_value) || '#' || coalesce(s.occ, t.occ) AS pair_id,
         coalesce(s.match_value, t.match_value) AS match_value, coalesce(s.occ, t.occ) AS occ,
         source_file, CASE WHEN source_file IS NOT NULL THEN 0 END AS source_tx,
         target_file, CASE WHEN target_file IS NOT NULL THEN 0 END AS target_tx
  FROM s_n s FULL OUTER JOIN t_n t ON s.match_value = t.match_value AND s.occ = t.occ)"""


def diff_ctes(book: R.RuleBook, crosswalk: list[dict] | None = None, suffix: str = "") -> str:
    """CTEs ending in ``diffs{suffix}`` for one rule set (needs INVOICE_CTES)."""
    x = suffix
    num = NUMERIC_PATTERN.replace("'", "''")

    def dbl(v: str) -> str:
        return (f"CASE WHEN regexp_matches({v}, '{num}') THEN "
                f"TRY_CAST(replace(trim({v}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)), '_', '') AS DOUBLE) END")

    return f""",
mr{x} AS ({merged_rules_sql(book, crosswalk)}),
ig{x} AS ({ignores_values(book)}),
s_fp{x} AS (SELECT p.pair_id, f.* FROM s_f f JOIN pairs p ON f.doc_id = p.source_file WHERE p.target_file IS NOT NULL),
t_fp{x} AS (SELECT p.pair_id, f.* FROM t_f f JOIN pairs p ON f.doc_id = p.target_file WHERE p.source_file IS NOT NULL),
s_lines{x} AS (SELECT pair_id, occ, '{{' || string_agg('''' || field || ''': ''' || value || '''', ', ' ORDER BY fpos) || '}}' AS repr
           FROM s_fp{x} WHERE section = 'line' GROUP BY pair_id, occ),
t_lines{x} AS (SELECT pair_id, occ, '{{' || string_agg('''' || field || ''': ''' || value || '''', ', ' ORDER BY fpos) || '}}' AS repr
           FROM t_fp{x} WHERE section = 'line' GROUP BY pair_id, occ),
presence{x} AS (
  SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, 'line_' || coalesce(s.occ, t.occ) AS segment, '' AS field,
         'hard' AS severity, s.repr AS source_value, t.repr AS target_value,
         CASE WHEN t.pair_id IS NULL THEN 'Missing line in Target at position ' || s.occ
              ELSE 'Extra line in Target at position ' || t.occ END AS description,
         FALSE AS wildcard
  FROM s_lines{x} s FULL OUTER JOIN t_lines{x} t ON s.pair_id = t.pair_id AND s.occ = t.occ
  WHERE s.pair_id IS NULL OR t.pair_id IS NULL),
fj{x} AS (
  SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.section, t.section) AS section,
         coalesce(s.occ, t.occ) AS occ, coalesce(s.field, t.field) AS field, s.value AS s, t.value AS t
  FROM s_fp{x} s FULL OUTER JOIN t_fp{x} t
    ON s.pair_id = t.pair_id AND s.section = t.section AND s.occ = t.occ AND s.field = t.field),
cand{x} AS (
  SELECT f.* FROM fj{x} f
  LEFT JOIN (SELECT DISTINCT a.pair_id, a.occ FROM s_lines{x} a JOIN t_lines{x} b USING (pair_id, occ)) two
    ON two.pair_id = f.pair_id AND two.occ = f.occ
  LEFT JOIN (SELECT DISTINCT field FROM ig{x} WHERE segment = '*') i ON i.field = f.field
  WHERE coalesce(s, '') <> coalesce(t, '') AND (section <> 'line' OR two.pair_id IS NOT NULL) AND i.field IS NULL
    AND (SELECT count(*) FROM ig{x} WHERE segment = '*' AND field = '*') = 0),
res{x} AS (
  SELECT c.*,
    CASE WHEN r1.segment IS NOT NULL THEN r1.severity WHEN r2.segment IS NOT NULL THEN r2.severity
         WHEN r3.segment IS NOT NULL THEN r3.severity WHEN r4.segment IS NOT NULL THEN r4.severity ELSE 'hard' END AS severity,
    CASE WHEN r1.segment IS NOT NULL THEN r1.ignore_case WHEN r2.segment IS NOT NULL THEN r2.ignore_case
         WHEN r3.segment IS NOT NULL THEN r3.ignore_case WHEN r4.segment IS NOT NULL THEN r4.ignore_case ELSE FALSE END AS ignore_case,
    CASE WHEN r1.segment IS NOT NULL THEN r1.numeric WHEN r2.segment IS NOT NULL THEN r2.numeric
         WHEN r3.segment IS NOT NULL THEN r3.numeric WHEN r4.segment IS NOT NULL THEN r4.numeric ELSE FALSE END AS numeric,
    CASE WHEN r1.segment IS NOT NULL THEN r1.conditional_qualifier WHEN r2.segment IS NOT NULL THEN r2.conditional_qualifier
         WHEN r3.segment IS NOT NULL THEN r3.conditional_qualifier WHEN r4.segment IS NOT NULL THEN r4.conditional_qualifier END AS cq,
    CASE WHEN r1.segment IS NOT NULL THEN r1.amount_variance WHEN r2.segment IS NOT NULL THEN r2.amount_variance
         WHEN r3.segment IS NOT NULL THEN r3.amount_variance WHEN r4.segment IS NOT NULL THEN r4.amount_variance END AS variance,
    (r1.segment IS NULL AND (r2.segment IS NULL) AND (r3.segment IS NULL OR c.field = '*')) AS wildcard
  FROM cand{x} c
  LEFT JOIN mr{x} r1 ON r1.segment = '*' AND r1.field = c.field
  LEFT JOIN mr{x} r2 ON r2.segment = '*' AND r2.field = '*' AND FALSE
  LEFT JOIN mr{x} r3 ON r3.segment = '*' AND r3.field = c.field
  LEFT JOIN mr{x} r4 ON r4.segment = '*' AND r4.field = '*'),
ev{x} AS (
  SELECT r.*, {dbl("coalesce(r.s, '')")} AS ds, {dbl("coalesce(r.t, '')")} AS dt,
    qs.value AS s_cq, qt.value AS t_cq
  FROM res{x} r
  LEFT JOIN s_fp{x} qs ON qs.pair_id = r.pair_id AND qs.section = r.section AND qs.occ = r.occ AND qs.field = r.cq
  LEFT JOIN t_fp{x} qt ON qt.pair_id = r.pair_id AND qt.section = r.section AND qt.occ = r.occ AND qt.field = r.cq),
diffs{x} AS (
  SELECT pair_id, segment, field, severity, source_value, target_value, description, wildcard FROM presence{x}
  UNION ALL
  SELECT pair_id,
    CASE WHEN section = 'line' THEN 'line_' || occ ELSE section END AS segment,
    field, severity, s AS source_value, t AS target_value,
    CASE WHEN s IS NULL THEN 'Missing key in Source: ' || field || ' (Target has: ''' || coalesce(t, '') || ''')'
         WHEN t IS NULL THEN 'Missing key in Target: ' || field || ' (Source has: ''' || coalesce(s, '') || ''')'
         ELSE 'Content mismatch: Source=''' || s || ''' vs Target=''' || t || '''' END AS description,
    wildcard
  FROM ev{x}
  WHERE NOT coalesce(numeric AND NOT isnan(ds) AND NOT isnan(dt)
                     AND CASE WHEN variance IS NULL THEN ds = dt ELSE abs(round(ds - dt, 9)) <= variance END, FALSE)
    AND NOT (CASE WHEN ignore_case THEN lower(coalesce(s, '')) = lower(coalesce(t, '')) ELSE coalesce(s, '') = coalesce(t, '') END)
    AND severity <> 'ignore'
    AND NOT (cq IS NOT NULL AND ((s IS NULL AND coalesce(s_cq, '') <> '') OR (t IS NULL AND coalesce(t_cq, '') <> ''))))"""


def base_sql(version: int = 1, crosswalk: list[dict] | None = None, extra_versions: tuple = ()) -> str:
    """WITH-clause prefix that ends with ``diffs`` (rules ``version``) and
    ``diffs_v{n}`` for each extra version; append a final SELECT."""
    out = "WITH " + INVOICE_CTES.strip() + diff_ctes(I.profile_rules(version), crosswalk)
    for v in extra_versions:
        out += diff_ctes(I.profile_rules(v), None, suffix=f"_v{v}")
    return materialized(out) + ",\nstatus AS MATERIALIZED (\n  SELECT p.*, CASE WHEN source_file IS NULL OR target_file IS NULL THEN 'UNMATCHED'\n" \
        "    WHEN coalesce(d.n, 0) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status,\n" \
        "    CASE WHEN source_file IS NULL OR target_file IS NULL THEN 0 ELSE coalesce(d.n, 0) END AS diff_count\n" \
        "  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM diffs GROUP BY pair_id) d USING (pair_id))\n"
