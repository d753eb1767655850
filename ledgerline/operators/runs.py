"""Stored reconciliation runs.

A run is written once: its diffs, its pairs with their statuses, and one row about the run,
each under its own ``run_id=<n>`` folder, the row about the run last, so a run that is listed
is complete.  Writing a run again replaces its folders and changes nothing else.  Readers name
the run, so Spark opens that run's files only (partition pruning), and declare the schema, so
a run without diffs, or a store without runs, reads as empty.

Reclassifying reads a stored run, resolves its diffs under other rules and writes a new run
with statuses counted anew: no document is compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import analysis as A
from ledgerline.operators import reconcile as RC
from ledgerline.operators import rules as R

PAIRS = ("pair_id string, match_value string, occ int, source_file string, source_tx int, target_file string, "
         "target_tx int, status string, diff_count bigint, run_id int")
DIFFS = ("pair_id string, segment string, field string, severity string, source_value string, target_value string, "
         "description string, wildcard boolean, run_id int")
RUNS = ("profile string, trading_partner string, transaction_type string, started_at string, reclassified_from int, "
        "total_pairs bigint, matched bigint, mismatched bigint, unmatched bigint, total_diffs bigint, run_id int")


class RunStore:
    """The runs under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # an empty run makes the folders, so an empty store can be read
        for name, schema in (("pairs", PAIRS), ("diffs", DIFFS), ("runs", RUNS)):
            spark.createDataFrame([], schema).drop("run_id").write.mode("ignore").parquet(f"{self.path}/{name}/run_id=0")

    def _write(self, df: DataFrame, name: str, run_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run_id={run_id}", compression="zstd")

    def _read(self, name: str, schema: str, run_id: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    def runs(self, run_id: int | None = None) -> DataFrame:
        return self._read("runs", RUNS, run_id)

    def pairs(self, run_id: int | None = None) -> DataFrame:
        return self._read("pairs", PAIRS, run_id)

    def diffs(self, run_id: int | None = None) -> DataFrame:
        return self._read("diffs", DIFFS, run_id)

    def write(self, run_id: int, pairs: DataFrame, diffs: DataFrame, profile: str = "", trading_partner: str = "",
              transaction_type: str = "", started_at: str = "", reclassified_from: int | None = None) -> None:
        """Store a run.  ``run_id`` is from 1 on; the diffs are computed here, once."""
        if run_id < 1:
            raise ValueError("runs are numbered from 1")
        self._write(diffs.select(*RC.DIFF_COLUMNS), "diffs", run_id)
        self._write(RC.pair_status(pairs, self.diffs(run_id)), "pairs", run_id)
        about = {"profile": profile, "trading_partner": trading_partner, "transaction_type": transaction_type,
                 "started_at": started_at}
        totals = RC.run_summary(self.pairs(run_id))
        self._write(totals.select(*[F.lit(v).alias(k) for k, v in about.items()],
                                  F.lit(reclassified_from).cast("int").alias("reclassified_from"),
                                  *[c for c in totals.columns if c in RUNS]), "runs", run_id)

    def about(self, run_id: int) -> dict:
        """The row about a run; an error where there is none."""
        row = self.runs(run_id).first()  # one row
        if row is None:
            raise ValueError(f"no run {run_id} in {self.path}")
        return row.asDict()

    def reclassify(self, run_id: int, new_id: int, book: R.RuleBook, crosswalk: list[dict] | None = None,
                   started_at: str = "") -> None:
        """Run ``new_id`` from the stored diffs of ``run_id`` under the given rules.  Diffs
        that are ignored now go; a pair without any left becomes MATCH; unmatched ones stay."""
        old = self.about(run_id)
        diffs = A.reclassify(self.spark, self.diffs(run_id).drop("run_id"), book, crosswalk)
        pairs = self.pairs(run_id).drop("run_id", "status", "diff_count")
        self.write(new_id, pairs, diffs, old["profile"], old["trading_partner"], old["transaction_type"], started_at, run_id)

    def compare(self, run_a: int, run_b: int) -> DataFrame:
        """What became of each (segment, field) between two runs."""
        return A.run_diff(self.diffs(run_a), self.diffs(run_b))

    def report(self, run_id: int) -> DataFrame:
        """The report rows of a run."""
        about = self.about(run_id)
        return A.report_rows(self.pairs(run_id).drop("run_id"), self.diffs(run_id).drop("run_id"), run_id,
                             about["profile"], about["trading_partner"], about["started_at"])
