"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
group of the blueprint, each reading the given tables (or data Spark derives
from them) in full.  ``ORACLE`` holds the DuckDB SQL that must give the same
rows; queries without SQL are checked against brute force in the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import analysis as A
from ledgerline.operators import reconcile as RC
from ledgerline.operators.changelog import ChangeLog
from ledgerline.plans import invoices as I
from ledgerline.plans import oracle_invoices as OI
from ledgerline.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ flat reconciliation

_BASE = OI.base_sql(1)
_BASE_V12 = OI.base_sql(1, extra_versions=(2,))


@register("flat_diffs", _BASE + "SELECT * FROM diffs")
def flat_diffs(spark, sf):
    """Every diff of the invoice run."""
    return I.flat_run(spark, sf)[1]


@register("pairs_status", _BASE + "SELECT pair_id, match_value, occ, source_file, target_file, status, diff_count FROM status")
def pairs_status(spark, sf):
    """Pairs with status and diff count."""
    pairs, diffs = I.flat_run(spark, sf)
    return RC.pair_status(pairs, diffs).select("pair_id", "match_value", "occ", "source_file", "target_file",
                                               "status", "diff_count")


@register("run_summary", _BASE + """SELECT count(*) AS total_pairs,
  count(*) FILTER (WHERE status = 'MATCH') AS matched,
  count(*) FILTER (WHERE status = 'MISMATCH') AS mismatched,
  count(*) FILTER (WHERE status = 'UNMATCHED') AS unmatched,
  count(*) FILTER (WHERE source_file IS NULL) AS target_only,
  count(*) FILTER (WHERE target_file IS NULL) AS source_only,
  CAST(coalesce(sum(diff_count), 0) AS BIGINT) AS total_diffs FROM status""")
def run_summary(spark, sf):
    """Run totals."""
    pairs, diffs = I.flat_run(spark, sf)
    return RC.run_summary(RC.pair_status(pairs, diffs))


# ------------------------------------------------------------------ analysis of stored runs

for _by in ("severity", "segment", "field"):
    def _mk(by):
        def q(spark, sf):
            return A.breakdown(I.run_store(spark, sf).diffs(1), by)
        q.__doc__ = f"A1–A3/J12: diff count per {by}."
        return q
    register(f"{_by}_breakdown", _BASE + f"SELECT {_by}, count(*) AS n FROM diffs GROUP BY {_by}")(_mk(_by))


@register("top_errors", _BASE + "SELECT segment, field, count(*) AS n FROM diffs GROUP BY segment, field "
                                 "ORDER BY n DESC, segment, field LIMIT 10")
def top_errors(spark, sf):
    """A4: top 10 (segment, field) – the flagship report."""
    return A.top_errors(I.run_store(spark, sf).diffs(1), 10)


@register("discoveries", _BASE + """SELECT segment, field,
  arg_min(source_value, pair_id) AS source_value, arg_min(target_value, pair_id) AS target_value,
  arg_min(severity, pair_id) AS suggested_severity, count(*) AS occurrences
  FROM diffs WHERE wildcard GROUP BY segment, field""")
def discoveries(spark, sf):
    """Unclassified (segment, field) combinations."""
    return A.discoveries(I.run_store(spark, sf).diffs(1))


@register("discoveries_new", OI.base_sql(1, extra_versions=(0,)) + """, new AS (
  SELECT segment, field, arg_min(source_value, pair_id) AS source_value, arg_min(target_value, pair_id) AS target_value,
         arg_min(severity, pair_id) AS suggested_severity, count(*) AS occurrences FROM diffs_v0 WHERE wildcard GROUP BY segment, field)
SELECT segment, field, source_value, target_value, suggested_severity, occurrences, field = 'total' AS applied
FROM new WHERE (segment, field) NOT IN (SELECT (segment, field) FROM diffs WHERE wildcard)""")
def discoveries_new(spark, sf):
    """A second run, under rules that classify nothing, adds only what the first did not
    find; a mark of one of them is read back from the log."""
    log = ChangeLog(spark, f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-log-{uuid.uuid4().hex}")
    log.discover(I.run_store(spark, sf).diffs(1), "invoices", 1)
    found = log.discover(I.flat_run(spark, sf, 0, inputs=I.stored_inputs(spark, sf))[1], "invoices", 2)
    log.mark(found.where("field = 'total'").select("profile", "segment", "field", F.lit(False).alias("applied"), F.lit("ops").alias("applied_by")), 1)
    log.mark(found.where("field = 'total'").select("profile", "segment", "field", F.lit(True).alias("applied"), F.lit("ops").alias("applied_by")), 2)
    return log.discovered().where("entry = 2").select(
        "segment", "field", "source_value", "target_value", "suggested_severity", "occurrences", "applied")


_RECLASSIFIED = _BASE + """, mr2 AS (""" + OI.merged_rules_sql(I.profile_rules(2)) + """),
rc AS (
  SELECT d.*, CASE WHEN r1.segment IS NOT NULL THEN r1.severity WHEN r2.segment IS NOT NULL THEN r2.severity
      WHEN r3.segment IS NOT NULL THEN r3.severity WHEN r4.segment IS NOT NULL THEN r4.severity ELSE 'hard' END AS new_severity
  FROM diffs d
  LEFT JOIN mr2 r1 ON r1.segment = split_part(d.segment, '*', 1) AND r1.field = d.field
  LEFT JOIN mr2 r2 ON r2.segment = split_part(d.segment, '*', 1) AND r2.field = '*'
  LEFT JOIN mr2 r3 ON r3.segment = '*' AND r3.field = d.field
  LEFT JOIN mr2 r4 ON r4.segment = '*' AND r4.field = '*'),
again AS (SELECT pair_id, segment, field, new_severity AS severity, source_value, target_value, description
          FROM rc WHERE new_severity <> 'ignore'),
again_status AS (
  SELECT p.pair_id, p.match_value, CASE WHEN source_file IS NULL OR target_file IS NULL THEN 'UNMATCHED'
      WHEN coalesce(n, 0) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status,
    CASE WHEN source_file IS NULL OR target_file IS NULL THEN 0 ELSE coalesce(n, 0) END AS diff_count
  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM again GROUP BY pair_id) USING (pair_id))
"""


@register("reclassify", _RECLASSIFIED + "SELECT * FROM again")
def reclassify(spark, sf):
    """Stored diffs re-resolved under the profile's version-2 rules."""
    d = A.reclassify(spark, I.run_store(spark, sf).diffs(1).drop("run_id"), I.profile_rules(2))
    return d.drop("wildcard")


@register("reclassify_status", _RECLASSIFIED + "SELECT * FROM again_status")
def reclassify_status(spark, sf):
    """Statuses of the run that reclassifying stored, counted from its own diffs."""
    return I.run_store(spark, sf).pairs(3).select("pair_id", "match_value", "status", "diff_count")


@register("run_diff", _BASE_V12 + """,
la AS (SELECT segment, field, arg_max(severity, pair_id) AS severity FROM diffs GROUP BY segment, field),
lb AS (SELECT segment, field, arg_max(severity, pair_id) AS severity FROM diffs_v2 GROUP BY segment, field)
SELECT coalesce(la.segment, lb.segment) AS segment, coalesce(la.field, lb.field) AS field,
  CASE WHEN la.segment IS NULL THEN 'new' WHEN lb.segment IS NULL THEN 'resolved'
       WHEN la.severity <> lb.severity THEN 'changed' ELSE 'unchanged' END AS change,
  la.severity AS severity_a, lb.severity AS severity_b
FROM la FULL OUTER JOIN lb ON la.segment = lb.segment AND la.field = lb.field""")
def run_diff(spark, sf):
    """The stored run with rules v1 against the stored full run with rules v2."""
    return I.run_store(spark, sf).compare(1, 2)


@register("report_rows", _BASE + """SELECT '2025-01-01T00:00:00' AS timestamp, 'invoices' AS profile, '' AS trading_partner, 1 AS run_id,
  s.pair_id, s.source_file, coalesce(s.target_file, '') AS target_file, s.match_value, s.status,
  coalesce(d.segment, '') AS segment, coalesce(d.field, '') AS field, coalesce(d.severity, '') AS severity,
  coalesce(d.source_value, '') AS source_value, coalesce(d.target_value, '') AS target_value,
  coalesce(d.description, '') AS description
FROM status s LEFT JOIN diffs d USING (pair_id)""")
def report_rows(spark, sf):
    """15-column report rows."""
    return I.run_store(spark, sf).report(1)


@register("report_header", _BASE + """SELECT 'invoices' AS profile, '' AS trading_partner, '810' AS transaction_type, 1 AS run_id,
  '2025-01-01T00:00:00' AS started, count(*) AS total_pairs, count(*) FILTER (WHERE status = 'MATCH') AS matched,
  count(*) FILTER (WHERE status = 'MISMATCH') AS mismatched, count(*) FILTER (WHERE status = 'UNMATCHED') AS unmatched
FROM status""")
def report_header(spark, sf):
    """Metadata of the report."""
    return A.report_header(I.run_store(spark, sf).pairs(1), 1, "invoices", "", "810", I.STARTED_AT)


@register("pairs_listing", _BASE + """SELECT pair_id, match_value, status, diff_count FROM status
WHERE status = 'MISMATCH' AND contains(lower(target_file), 'inv_1') ORDER BY pair_id DESC LIMIT 50 OFFSET 10""")
def pairs_listing(spark, sf):
    """A page of the pairs of one status whose target file holds a text."""
    return A.listing(I.run_store(spark, sf).pairs(1), "pair_id", 10, 50, {"target_file": "INV_1"}, status="MISMATCH").select(
        "pair_id", "match_value", "status", "diff_count")


@register("diffs_listing", _BASE + """SELECT pair_id, segment, field, severity, source_value, target_value FROM diffs
WHERE severity = 'hard' AND contains(lower(field), 'quantity') ORDER BY pair_id DESC, segment DESC, field DESC LIMIT 50 OFFSET 5""")
def diffs_listing(spark, sf):
    """A page of one run's diffs of a severity whose field holds a text."""
    return A.listing(I.run_store(spark, sf).diffs(1), ["pair_id", "segment", "field"], 5, 50, {"field": "Quantity"},
                     severity="hard").select("pair_id", "segment", "field", "severity", "source_value", "target_value")


@register("report_footer", _BASE + "SELECT severity, count(*) AS n FROM diffs GROUP BY severity")
def report_footer(spark, sf):
    """Severity footer of the report."""
    return A.report_footer(I.run_store(spark, sf).report(1))
