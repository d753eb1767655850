"""Tables that only grow, with the latest row of a key in force.

What runs find out and what users decide is appended under one folder for each entry, so
writers never rewrite each other's rows and a repeated write of an entry replaces itself.
The state is an aggregate over the log (``max_by``, combined before the shuffle), not a
table that is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import analysis as A

KEY = ["profile", "segment", "field"]
DISCOVERIES = ("profile string, segment string, field string, source_value string, target_value string, "
               "suggested_severity string, occurrences bigint, entry int")
EVENTS = "profile string, segment string, field string, applied boolean, applied_by string, entry int"
CROSSWALK = ("profile string, segment string, field string, severity string, ignore_case boolean, numeric boolean, "
             "amount_variance double, entry int")


class ChangeLog:
    """Discoveries, their applied marks and crosswalk rows of comparison profiles."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("discoveries", DISCOVERIES), ("events", EVENTS), ("crosswalk", CROSSWALK)):
            spark.createDataFrame([], schema).drop("entry").write.mode("ignore").parquet(f"{self.path}/{name}/entry=0")

    def _append(self, rows: DataFrame, name: str, entry: int, schema: str) -> None:
        if entry < 1:
            raise ValueError("entries are numbered from 1")
        empty = self.spark.createDataFrame([], schema).drop("entry")
        full = empty.unionByName(rows, allowMissingColumns=True).select(empty.columns)
        full.write.mode("overwrite").parquet(f"{self.path}/{name}/entry={entry}")

    def _log(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("entry") < before)

    def discover(self, diffs: DataFrame, profile: str, entry: int) -> DataFrame:
        """Note what ``diffs`` shows as unclassified and earlier entries do not have
        (insert-or-ignore), and return these rows."""
        known = self._log("discoveries", DISCOVERIES, entry).where(F.col("profile") == profile)
        found = A.discoveries(diffs, known).withColumn("profile", F.lit(profile))
        self._append(found, "discoveries", entry, DISCOVERIES)
        return self._log("discoveries", DISCOVERIES).where((F.col("entry") == entry) & (F.col("profile") == profile))

    def mark(self, rows: DataFrame, entry: int) -> None:
        """(profile, segment, field, applied, applied_by); the latest entry counts."""
        self._append(rows, "events", entry, EVENTS)

    def discovered(self) -> DataFrame:
        """All discoveries with their latest mark."""
        marks = self._log("events", EVENTS).groupBy(*KEY).agg(F.max_by(F.struct("applied", "applied_by"), "entry").alias("_e"))
        return (self._log("discoveries", DISCOVERIES).join(marks, KEY, "left")
                .withColumns({"applied": F.coalesce("_e.applied", F.lit(False)), "applied_by": F.col("_e.applied_by")}).drop("_e"))

    def upsert(self, rows: DataFrame, entry: int) -> None:
        """C20: crosswalk rows; of a key the latest entry counts, whole."""
        self._append(rows, "crosswalk", entry, CROSSWALK)

    def crosswalk(self, profile: str) -> DataFrame:
        """The crosswalk rows in force for a profile."""
        attrs = ["severity", "ignore_case", "numeric", "amount_variance"]
        return (self._log("crosswalk", CROSSWALK).where(F.col("profile") == profile).groupBy(*KEY)
                .agg(F.max_by(F.struct(*attrs), "entry").alias("_r")).select(*KEY, "_r.*"))
