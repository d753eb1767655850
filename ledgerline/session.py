"""Session helpers: one place for the configs every job here relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, app: str = "ledgerline",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session.

    Settings belong to spark-submit; they are made here only for a run that names its own
    ``master`` (tests, bench).
    """
    b = SparkSession.builder.appName(app)
    if master:
        parts = shuffle_partitions or int(os.environ.get("LEDGERLINE_SHUFFLE_PARTITIONS", "8"))
        b = (b.master(master)
              .config("spark.ui.enabled", "false")
              .config("spark.ui.showConsoleProgress", "false")
              .config("spark.sql.shuffle.partitions", str(parts))
              .config("spark.sql.session.timeZone", "UTC")
              .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, which the cluster
    names.  Where it is unset, a local master gets a scratch folder; on a cluster that is
    an error, as executors do not see the driver's disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def store(df: DataFrame) -> DataFrame:
    """Write an intermediate that several consumers read as Parquet in the shared folder,
    and read it back: computed once, columns pruned on each read, and a lost executor
    does not recompute the chain.  Zstandard: rendered text takes a good part less than in
    Spark's own choice, and these tables are written once and read a few times.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` into ``spark.sql.shuffle.partitions``.

    Used on the document side before per-document text work (render, parse,
    hash).  The explicit count keeps AQE from coalescing it back into one task
    when the input is a single small file; on a large input this is the same
    shuffle a join on the key would do anyway, and a later join or aggregation
    on the key reuses it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
