"""DuckDB SQL oracle for the X12 plans.

Builds the expected segment rows of every interchange straight from the
tables (no text rendering, no parsing), so a Spark result that went through
render -> tokenise -> split transactions must reproduce them exactly.
"""

from __future__ import annotations

from ledgerline.functions.transforms import NUMERIC_PATTERN
from ledgerline.operators.reconcile import x12_field_index
from ledgerline.plans import invoices as I
from ledgerline.plans import oracle_invoices as OI
from ledgerline.plans import x12docs as X


def _side_rows(side: str) -> str:
    tgt = side == "target"
    p = side[0]
    qty = ("CAST(CASE WHEN l_partkey % 17 = 0 THEN CAST(l_quantity AS DECIMAL(18,2)) + 1 "
           "ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS DECIMAL(18,2))") if tgt else "CAST(l_quantity AS DECIMAL(18,2))"
    price = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
    if tgt:
        price = f"regexp_replace(regexp_replace({price}, '0+$', ''), '\\.$', '')"
    has_dtm = "(o_orderkey % 23 <> 0)" if tgt else "TRUE"
    inv = "'INV-' || o_orderkey" if tgt else "CAST(o_orderkey AS VARCHAR)"
    st_name = "CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END" if tgt \
        else "o_orderpriority"
    cents = "CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT)"
    if tgt:
        cents += " + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END"
    comp = X.SEPARATORS[side][2]
    drop = {"source": "o_orderkey % 13 <> 0", "target": "o_orderkey % 11 <> 0 OR o_orderkey % 13 = 0", "book": "TRUE"}[side]
    last = "AND NOT (l_orderkey % 19 = 0 AND line_no = n_lines - 1)" if tgt else ""
    doc = f"'{side}/810_' || o_orderkey || '.edi'"
    return f"""
{p}x_o AS (SELECT * FROM orders WHERE {drop}),
{p}x_l AS (SELECT * FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM {p}x_o) {last}),
{p}x_n AS (SELECT l_orderkey, count(*) AS n FROM {p}x_l GROUP BY l_orderkey),
{p}x_h AS (SELECT o.*, coalesce(n, 0) AS n, strftime(o_orderdate, '%Y%m%d') AS ymd,
               lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS ctrl, {has_dtm} AS has_dtm
           FROM {p}x_o o LEFT JOIN {p}x_n ON o_orderkey = l_orderkey),
{p}x_rows AS (
  SELECT {doc} AS doc_id, 0 AS block, 0 AS sub, ['ISA', '00', '{" " * 10}', '00', '{" " * 10}', 'ZZ', '{X.SENDER.ljust(15)}',
         'ZZ', '{X.RECEIVER.ljust(15)}', strftime(o_orderdate, '%y%m%d'), '0000', 'U', '00401', ctrl, '0', 'P', '{comp}'] AS elements FROM {p}x_h
  UNION ALL SELECT {doc}, 1, 0, ['GS', 'IN', '{X.SENDER}', '{X.RECEIVER}', ymd, '0000', CAST(o_orderkey AS VARCHAR), 'X', '004010'] FROM {p}x_h
  UNION ALL SELECT {doc}, 2, 0, ['ST', '810', '0001'] FROM {p}x_h
  UNION ALL SELECT {doc}, 3, 0, ['BIG', ymd, {inv}, '', 'PO' || o_orderkey] FROM {p}x_h
  UNION ALL SELECT {doc}, 4, 0, ['N1', 'BY', 'CUSTOMER ' || o_custkey, '92', CAST(o_custkey AS VARCHAR)] FROM {p}x_h
  UNION ALL SELECT {doc}, 4, 1, ['N1', 'ST', {st_name}, '92', CAST(o_custkey AS VARCHAR)] FROM {p}x_h
  UNION ALL SELECT {doc}, 5, 0, ['DTM', '011', ymd] FROM {p}x_h WHERE has_dtm
  UNION ALL SELECT {doc}, 7, 0, ['TDS', CAST({cents} AS VARCHAR)] FROM {p}x_h
  UNION ALL SELECT {doc}, 8, 0, ['CTT', CAST(n AS VARCHAR)] FROM {p}x_h
  UNION ALL SELECT {doc}, 9, 0, ['SE', CAST(n + 6 + CAST(has_dtm AS INTEGER) AS VARCHAR), '0001'] FROM {p}x_h
  UNION ALL SELECT {doc}, 10, 0, ['GE', '1', CAST(o_orderkey AS VARCHAR)] FROM {p}x_h
  UNION ALL SELECT {doc}, 11, 0, ['IEA', '1', ctrl] FROM {p}x_h
  UNION ALL SELECT '{side}/810_' || l_orderkey || '.edi', 6, line_no,
         ['IT1', CAST(line_no + 1 AS VARCHAR), CAST({qty} AS VARCHAR), 'EA', {price}, '', 'VP',
          CAST(l_partkey AS VARCHAR), 'SU', CAST(l_suppkey AS VARCHAR)] FROM {p}x_l),
{p}x_seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, sub) - 1 AS seg_pos,
                    elements[1] AS segment, elements FROM {p}x_rows)"""


def segments_sql() -> str:
    """WITH prefix ending in ``sx_seg``, ``tx_seg`` and ``bx_seg`` (all segments per side)."""
    return f"""WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(I.LINE_ORDER)}) - 1 AS line_no,
         count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem),""" + \
        ",".join(map(_side_rows, ("source", "target", "book"))) + "\n"


def _qual_case() -> str:
    parts = [f"WHEN '{seg}' THEN coalesce(elements[{x12_field_index(q) + 1}], '')"
             for seg, q in sorted(X.QUALIFIERS.items()) if q]
    return "CASE segment " + " ".join(parts) + " END"


def diffs_sql() -> str:
    """WITH prefix ending in ``pairs`` and ``diffs`` for the X12 run."""
    tiered = X.x12_rules()
    num = NUMERIC_PATTERN.replace("'", "''")

    def dbl(v: str) -> str:
        return (f"CASE WHEN regexp_matches({v}, '{num}') THEN "
                f"TRY_CAST(replace(trim({v}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)), '_', '') AS DOUBLE) END")

    hasq = "segment IN (" + ", ".join(f"'{s}'" for s, q in sorted(X.QUALIFIERS.items()) if q) + ")"
    side_ctes = []
    for p, col, other in (("s", "source_file", "target_file"), ("t", "target_file", "source_file")):
        side_ctes.append(f"""
{p}_tx AS (SELECT * FROM {p}x_seg WHERE segment NOT IN ('ISA', 'GS', 'GE', 'IEA')),
{p}_key AS (SELECT doc_id, arg_min(regexp_replace(elements[3], '^INV-', ''), seg_pos) AS match_value
            FROM {p}_tx WHERE segment = 'BIG' AND coalesce(elements[3], '') <> '' GROUP BY doc_id),
{p}_num AS (SELECT match_value, row_number() OVER (PARTITION BY match_value ORDER BY doc_id) AS occ, doc_id AS {col} FROM {p}_key)""")
    side2 = []
    for p, col, other in (("s", "source_file", "target_file"), ("t", "target_file", "source_file")):
        side2.append(f"""
{p}_q AS (SELECT p.pair_id, x.seg_pos, x.segment, x.elements, {hasq} AS hasq,
                 CASE WHEN {hasq} THEN {_qual_case()} END AS qual
          FROM {p}_tx x JOIN pairs p ON x.doc_id = p.{col} WHERE p.{other} IS NOT NULL),
{p}_qo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, segment, qual ORDER BY seg_pos) - 1 AS occ,
                  coalesce(qual, '') AS qk FROM {p}_q),
{p}_ql AS (SELECT *, CASE WHEN NOT hasq THEN segment || '*position_' || occ WHEN qual <> '' THEN segment || '*' || qual
                          ELSE segment END AS label FROM {p}_qo),
{p}_f AS (SELECT pair_id, segment, qk, occ, label, i AS fpos, segment || lpad(CAST(i AS VARCHAR), 2, '0') AS field,
                 elements[i + 1] AS value
          FROM {p}_ql, LATERAL (SELECT unnest(range(1, len(elements))) AS i)),
{p}_repr AS (SELECT q.pair_id, q.segment, q.qk, q.occ, q.label,
               '{{' || coalesce(string_agg('''' || f.field || ''': ''' || f.value || '''', ', ' ORDER BY f.fpos), '') || '}}' AS repr
             FROM {p}_ql q LEFT JOIN {p}_f f USING (pair_id, segment, qk, occ)
             GROUP BY q.pair_id, q.segment, q.qk, q.occ, q.label)""")
    ign = OI.ignores_values(tiered)
    return OI.materialized(segments_sql() + "," + ",".join(side_ctes) + f""",
pairs AS (
  SELECT coalesce(s.match_value, t.match_value) || '#' || coalesce(s.occ, t.occ) AS pair_id,
         coalesce(s.match_value, t.match_value) AS match_value, coalesce(s.occ, t.occ) AS occ,
         source_file, target_file
  FROM s_num s FULL OUTER JOIN t_num t ON s.match_value = t.match_value AND s.occ = t.occ),""" + ",".join(side2) + f""",
mr AS ({OI.merged_rules_sql(tiered)}),
ig AS ({ign}),
presence AS (
  SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.label, t.label) AS segment, '' AS field, 'hard' AS severity,
         s.repr AS source_value, t.repr AS target_value,
         CASE WHEN t.pair_id IS NULL THEN 'Missing segment in Target: ' || s.label
              ELSE 'Extra segment in Target: ' || t.label END AS description, FALSE AS wildcard
  FROM s_repr s FULL OUTER JOIN t_repr t ON s.pair_id = t.pair_id AND s.segment = t.segment AND s.qk = t.qk AND s.occ = t.occ
  WHERE s.pair_id IS NULL OR t.pair_id IS NULL),
both_seg AS (SELECT pair_id, segment, qk, occ FROM s_repr INTERSECT SELECT pair_id, segment, qk, occ FROM t_repr),
fj AS (
  SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.segment, t.segment) AS seg, coalesce(s.qk, t.qk) AS qk,
         coalesce(s.occ, t.occ) AS occ, coalesce(s.label, t.label) AS label, coalesce(s.field, t.field) AS field,
         s.value AS s, t.value AS t
  FROM s_f s FULL OUTER JOIN t_f t ON s.pair_id = t.pair_id AND s.segment = t.segment AND s.qk = t.qk
                                  AND s.occ = t.occ AND s.field = t.field),
cand AS (
  SELECT f.* FROM fj f JOIN both_seg b ON f.pair_id = b.pair_id AND f.seg = b.segment AND f.qk = b.qk AND f.occ = b.occ
  WHERE coalesce(s, '') <> coalesce(t, '')
    AND (f.seg, f.field) NOT IN (SELECT (segment, field) FROM ig) AND f.seg NOT IN (SELECT segment FROM ig WHERE field = '*')
    AND f.field NOT IN (SELECT field FROM ig WHERE segment = '*')),
res AS (
  SELECT c.*,
    CASE WHEN r1.segment IS NOT NULL THEN r1.severity WHEN r2.segment IS NOT NULL THEN r2.severity
         WHEN r3.segment IS NOT NULL THEN r3.severity WHEN r4.segment IS NOT NULL THEN r4.severity ELSE 'hard' END AS severity,
    CASE WHEN r1.segment IS NOT NULL THEN r1.ignore_case WHEN r2.segment IS NOT NULL THEN r2.ignore_case
         WHEN r3.segment IS NOT NULL THEN r3.ignore_case WHEN r4.segment IS NOT NULL THEN r4.ignore_case ELSE FALSE END AS ignore_case,
    CASE WHEN r1.segment IS NOT NULL THEN r1.numeric WHEN r2.segment IS NOT NULL THEN r2.numeric
         WHEN r3.segment IS NOT NULL THEN r3.numeric WHEN r4.segment IS NOT NULL THEN r4.numeric ELSE FALSE END AS numeric,
    CASE WHEN r1.segment IS NOT NULL THEN r1.conditional_qualifier WHEN r2.segment IS NOT NULL THEN r2.conditional_qualifier
         WHEN r3.segment IS NOT NULL THEN r3.conditional_qualifier WHEN r4.segment IS NOT NULL THEN r4.conditional_qualifier END AS cq,
    (r1.segment IS NULL AND (r2.segment IS NULL OR c.seg = '*') AND (r3.segment IS NULL OR c.field = '*')) AS wildcard
  FROM cand c
  LEFT JOIN mr r1 ON r1.segment = c.seg AND r1.field = c.field
  LEFT JOIN mr r2 ON r2.segment = c.seg AND r2.field = '*'
  LEFT JOIN mr r3 ON r3.segment = '*' AND r3.field = c.field
  LEFT JOIN mr r4 ON r4.segment = '*' AND r4.field = '*'),
ev AS (
  SELECT r.*, {dbl("coalesce(r.s, '')")} AS ds, {dbl("coalesce(r.t, '')")} AS dt,
    qs.value AS s_cq, qt.value AS t_cq
  FROM res r
  LEFT JOIN s_f qs ON qs.pair_id = r.pair_id AND qs.segment = r.seg AND qs.qk = r.qk AND qs.occ = r.occ AND qs.field = r.cq
  LEFT JOIN t_f qt ON qt.pair_id = r.pair_id AND qt.segment = r.seg AND qt.qk = r.qk AND qt.occ = r.occ AND qt.field = r.cq),
diffs AS (
  SELECT pair_id, segment, field, severity, source_value, target_value, description, wildcard FROM presence
  UNION ALL
  SELECT pair_id, label AS segment, field, severity, s AS source_value, t AS target_value,
    CASE WHEN s IS NULL THEN 'Missing field in Source: ' || field || ' (Target has: ''' || coalesce(t, '') || ''')'
         WHEN t IS NULL THEN 'Missing field in Target: ' || field || ' (Source has: ''' || coalesce(s, '') || ''')'
         ELSE 'Content mismatch: Source=''' || s || ''' vs Target=''' || t || '''' END AS description,
    wildcard
  FROM ev
  WHERE NOT coalesce(numeric AND NOT isnan(ds) AND NOT isnan(dt) AND ds = dt, FALSE)
    AND NOT (CASE WHEN ignore_case THEN lower(coalesce(s, '')) = lower(coalesce(t, '')) ELSE coalesce(s, '') = coalesce(t, '') END)
    AND severity <> 'ignore'
    AND NOT (cq IS NOT NULL AND ((s IS NULL AND coalesce(s_cq, '') <> '') OR (t IS NULL AND coalesce(t_cq, '') <> ''))))
""")


def routed_sql() -> str:
    """WITH prefix ending in ``docs`` and ``doc_lines``: the transactions of the mixed files,
    each mapped by its type's map, the default where the type has none."""
    return segments_sql() + """,
mixed AS (SELECT *, CAST(regexp_extract(doc_id, '(\\d+)\\.edi', 1) AS BIGINT) AS k FROM bx_seg),
kinds AS (
  SELECT DISTINCT doc_id, k, unnest(CASE k % 5 WHEN 1 THEN [{'i': 0, 't': '850'}] WHEN 2 THEN [{'i': 0, 't': '997'}]
    WHEN 3 THEN [{'i': 0, 't': '810'}, {'i': 1, 't': '850'}]
    ELSE [{'i': 0, 't': CASE WHEN k % 40 = 4 THEN NULL ELSE '810' END}] END) AS tx FROM mixed),
typed AS (SELECT doc_id, tx.i AS tx_index, tx.t AS transaction_type, CASE tx.t WHEN '850' THEN '850' ELSE '810' END AS map,
                 coalesce(tx.t NOT IN ('810', '850'), TRUE) AS unmapped FROM kinds),
firsts AS (
  SELECT doc_id, any_value(elements) FILTER (segment = 'BIG') AS big, any_value(elements) FILTER (segment = 'TDS') AS tds,
         any_value(elements) FILTER (segment = 'CTT') AS ctt, arg_min(elements, seg_pos) FILTER (segment = 'N1') AS n1
  FROM mixed GROUP BY doc_id),
docs AS (
  SELECT t.*, CAST(CASE map WHEN '850' THEN to_json({'header': {'po_number': big[5], 'reference': big[3]},
                                      'summary': {'line_count': CAST(ctt[2] AS BIGINT)}})
    ELSE to_json({'header': {'invoice_number': big[3], 'po_number': big[5], 'customer': CAST(n1[5] AS BIGINT)},
                  'summary': {'total_cents': CAST(tds[2] AS BIGINT)}}) END AS VARCHAR) AS doc
  FROM typed t JOIN firsts USING (doc_id)),
doc_lines AS (
  SELECT t.doc_id, t.tx_index, CAST(elements[2] AS BIGINT) - 1 AS line_no, map, unmapped,
    CAST(CASE map WHEN '850' THEN to_json({'line': CAST(elements[2] AS BIGINT), 'part': elements[8], 'quantity': elements[3]})
      ELSE to_json({'line': CAST(elements[2] AS BIGINT), 'part': elements[8]}) END AS VARCHAR) AS line
  FROM typed t JOIN mixed m USING (doc_id) WHERE segment = 'IT1')
"""
