"""Helpers of the operators: tables in the shared folder, batches, row names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch (and one row more): texts may be long, narrow rows come by thousands.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see.  Where it is
    unset, a local master gets a scratch folder; a cluster gets an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerline-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: computed
    once, columnar, and safe from lost executors.  Zstandard: texts take a good part less."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy when it holds over one row in so many; so there are fewer heavy keys than this.
HEAVY = 1000


def join_skewed(rows: DataFrame, about: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``about``, which has one row for each key.

    Rows of heavy keys get theirs by a broadcast of fewer than ``HEAVY`` rows and stay where
    they are, so no task receives all rows of one key; the rest are joined by a shuffle.
    Rows with a null key match nothing."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = write_through(counts.where(F.col("_n") * HEAVY > rows.count()).where("_n > 100").select(*keys), "heavy")
    if heavy.isEmpty():
        return rows.join(about, keys)
    few = F.broadcast(about.join(F.broadcast(heavy), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(heavy), keys, "left_anti").join(about, keys))


_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Before Python runs on executors: ship this package to them, and bound Arrow batches by
    their bytes, as rows may hold very long texts.  A bound that the user has set stays, and
    the number of rows is not touched."""
    if spark.sparkContext.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # on the driver; Spark hands it out to the executors, also to those that join later
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerline-code-"), "ledgerline_llm.zip")
        with zipfile.ZipFile(path, "w") as z:
            for part in ("", "llm"):
                for name in sorted(os.listdir(os.path.join(root, part))):
                    if name.endswith(".py"):
                        z.write(os.path.join(root, part, name), os.path.join("ledgerline", part, name))
        spark.sparkContext.addPyFile(path)
        _shipped.add(spark.sparkContext.applicationId)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):  # Spark's own value
        spark.conf.set(key, f"{BATCH_BYTES}b")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """For each batch the named columns as lists; names ending in ``:bytes`` as UTF-8."""
    for b in batches:
        if b.num_rows:
            yield tuple(utf8(b.column(n[:-6])) if n.endswith(":bytes") else b.column(n).to_pylist()
                        for n in names)
