"""Running values over groups that span several tasks."""

import pytest
from pyspark.sql import functions as F

from ledgerline.carry import AT, Fold, in_order, running


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small tables keep their tasks, so groups cross borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_across_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 3 >= 2).cast("int").alias("g"), F.col("id").alias("o"),
                                  F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"))
    placed = in_order(df.repartition(8), "g", "o")
    assert placed.select(F.shiftright(AT, 33)).distinct().count() > 1
    got = running(placed, ["g"], n=Fold("count"), s=Fold("sum", F.col("o")), x=Fold("xor", F.col("o")), k0=Fold("last", F.col("k")))
    want = {}
    for g in (0, 1):
        n = s = x = 0
        k = None
        for o in range(1000):
            if o % 3 // 2 == g:
                n, s, x, k = n + 1, s + o, x ^ o, o if o % 50 == 0 else k
                want[o] = (g, n, s, x, k)
    assert {r.o: (r.g, r.n, r.s, r.x, r.k0) for r in got.collect()} == want
