"""Analysis of reconciliation runs.

Inputs are the ``pairs``/``statuses`` and ``diffs`` DataFrames of a run (or
the Parquet tables they were written to, partitioned by ``run_id``).  All
aggregations are partial-then-final (map-side combine), so the shuffle carries
one row per group and task, not one per diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R


def breakdown(diffs: DataFrame, by: str) -> DataFrame:
    """A1/A2/A3: diff count per severity, segment or field."""
    return diffs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top_errors(diffs: DataFrame, n: int = 10) -> DataFrame:
    """A4: the ``n`` most frequent (segment, field); ties by name for a stable result.

    The limit is the feature (a top-k report).  Spark plans it as
    TakeOrderedAndProject: each task keeps its own top ``n``.
    """
    return (diffs.groupBy("segment", "field").agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(F.desc("n"), "segment", "field").limit(n))


def discoveries(diffs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(segment, field) combinations that fell through to a wildcard.

    One row per combination, the first seen (lowest pair id) kept; combinations
    already discovered for the profile are left out (insert-or-ignore).
    """
    d = (diffs.filter(F.col("wildcard"))
              .groupBy("segment", "field")
              .agg(F.min_by(F.struct("source_value", "target_value", "severity"), "pair_id").alias("first"),
                   F.count(F.lit(1)).alias("occurrences"))
              .select("segment", "field", F.col("first.source_value").alias("source_value"),
                      F.col("first.target_value").alias("target_value"),
                      F.col("first.severity").alias("suggested_severity"), "occurrences"))
    if known is not None:
        d = d.join(known.select("segment", "field"), ["segment", "field"], "left_anti")
    return d


def mark_applied(discovered: DataFrame, events: DataFrame) -> DataFrame:
    """Discoveries with their latest ``applied`` event (append log, latest wins)."""
    last = (events.groupBy("segment", "field")
                  .agg(F.max_by(F.struct("applied", "applied_by"), "event_seq").alias("e")))
    return (discovered.join(last, ["segment", "field"], "left")
                      .select(*discovered.columns,
                              F.coalesce(F.col("e.applied"), F.lit(False)).alias("applied"),
                              F.col("e.applied_by").alias("applied_by")))


def reclassify(spark: SparkSession, diffs: DataFrame, book: R.RuleBook,
               crosswalk: list[dict] | None = None) -> DataFrame:
    """Re-resolve the severity of stored diffs under current rules.

    The rule segment is the label up to the first ``*``; diffs whose new
    severity is ``ignore`` are dropped.  Values and texts are kept, nothing is
    re-compared – this is what makes tuning cheap.
    """
    merged = R.merge_config(book, crosswalk)
    star = next((m for m in merged if m["segment"] == "*" and m["field"] == "*"), None)
    keyed = diffs.withColumn("rule_segment", F.substring_index("segment", "*", 1))
    res = R.resolve(keyed.drop("severity", "wildcard"), R.merged_frame(spark, book, crosswalk),
                    seg_col="rule_segment", field_col="field", star_rule=star, n_rules=len(merged))
    return (res.filter(F.col("severity") != "ignore")
               .select(*[c for c in RC.DIFF_COLUMNS if c != "wildcard"], "wildcard"))


def run_diff(diffs_a: DataFrame, diffs_b: DataFrame) -> DataFrame:
    """Compare two runs by (segment, field).

    Per run the latest diff of a key wins (highest pair id); then a full outer
    join classifies each key as new, resolved, changed (severity) or unchanged.
    """
    def latest(d: DataFrame, tag: str) -> DataFrame:
        return (d.groupBy("segment", "field")
                 .agg(F.max_by(F.struct("severity", "source_value", "target_value"), "pair_id").alias(tag)))

    j = latest(diffs_a, "a").join(latest(diffs_b, "b"), ["segment", "field"], "full_outer")
    change = (F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved")
               .when(F.col("a.severity") != F.col("b.severity"), "changed").otherwise("unchanged"))
    return j.select("segment", "field", change.alias("change"),
                    F.col("a.severity").alias("severity_a"), F.col("b.severity").alias("severity_b"))


def report_rows(statuses: DataFrame, diffs: DataFrame, run_id: int, profile: str,
                trading_partner: str = "", started_at: str = "") -> DataFrame:
    """The 15-column report – one row per diff, one blank row per clean pair.

    No pair cap (the original stops at 10,000 pairs).  ``timestamp`` is when the run
    started; metadata and the severity footer are ``report_header`` and ``report_footer``.
    """
    j = statuses.join(diffs, "pair_id", "left")
    blank = F.col("segment").isNull()
    def v(c):
        return F.when(blank, F.lit("")).otherwise(F.coalesce(F.col(c), F.lit("")))
    return j.select(
        F.lit(started_at).alias("timestamp"), F.lit(profile).alias("profile"),
        F.lit(trading_partner).alias("trading_partner"), F.lit(run_id).alias("run_id"), "pair_id", "source_file",
        F.coalesce("target_file", F.lit("")).alias("target_file"), "match_value", "status",
        v("segment").alias("segment"), v("field").alias("field"), v("severity").alias("severity"),
        v("source_value").alias("source_value"), v("target_value").alias("target_value"),
        v("description").alias("description"))


def report_header(statuses: DataFrame, run_id: int, profile: str, trading_partner: str = "",
                  transaction_type: str = "", started_at: str = "") -> DataFrame:
    """The metadata of a report, one row."""
    about = {"profile": profile, "trading_partner": trading_partner, "transaction_type": transaction_type,
             "run_id": run_id, "started": started_at}
    return RC.run_summary(statuses).select(*[F.lit(v).alias(k) for k, v in about.items()], "total_pairs", "matched",
                                           "mismatched", "unmatched")


def report_footer(report: DataFrame) -> DataFrame:
    """Severity counts of the report rows that carry a diff."""
    return report.filter(F.col("severity") != "").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def listing(df: DataFrame, order_by: str | list[str], offset: int = 0, limit: int = 50,
            text: dict[str, str] | None = None, **filters) -> DataFrame:
    """Newest first, filtered by equal values and by ``text`` that a column holds
    in any case, paged (the page size is the feature)."""
    order = [order_by] if isinstance(order_by, str) else order_by
    for col, part in (text or {}).items():
        df = df.filter(F.lower(col).contains(part.lower()))
    for col, val in filters.items():
        df = df.filter(F.col(col) == val)
    return df.orderBy(*map(F.desc, order)).offset(offset).limit(limit)
