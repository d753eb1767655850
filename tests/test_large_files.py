"""X12 loops and boundary keys: in the row, by windows, and carried from task to task."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.carry import in_order
from ledgerline.sources import delimited as D
from ledgerline.sources import x12 as X

ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *250115*1200*U*00401*000000001*0*P*>~"


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small tables keep their tasks, so files cross borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_loops(segments):
    """(tx_index, seg_pos) of the segments in loops."""
    out, open_from, n = [], None, 0
    for pos, seg in enumerate(segments):
        if seg == "ST":
            open_from = pos
        if seg == "SE" and open_from is not None:
            out += [(n, p) for p in range(open_from, pos + 1)]
            open_from, n = None, n + 1
    return out


def files(seed, n):
    r = random.Random(seed)
    return {f"f{i}": ["ISA", *r.choices(["ST", "SE", "BIG", "STX", "GE"], weights=[3, 3, 5, 1, 1], k=r.randrange(0, 60 if i else 400))]
            for i in range(n)}


def test_loops_three_ways(spark):
    given = files(3, 12)
    texts = [(name, ISA + "".join(f"{s}*{i}~" if i % 2 else f"{s}~\n" for i, s in enumerate(segs[1:]))) for name, segs in given.items()]
    df = spark.createDataFrame(texts, "doc_id string, content string")
    want = sorted((name, tx, pos) for name, segs in given.items() for tx, pos in plain_loops(segs))
    segments, errors = X.parse(df)
    in_row, _ = X.parse_transactions(df)
    windows = X.transactions(segments)
    large = X.transactions_of_large(in_order(segments, "doc_id", "seg_pos"))
    key = ["doc_id", "tx_index", "seg_pos"]
    for found in (in_row, windows, large):
        assert sorted(tuple(r) for r in found.select(key).collect()) == want
    texts_of = [sorted(tuple(r) for r in x.select(*key, "segment", F.array_join("elements", "|")).collect()) for x in (in_row, large)]
    assert texts_of[0] == texts_of[1] and errors.count() == 0


def test_content_that_is_no_interchange(spark):
    df = spark.createDataFrame([("a", "ISA fragment"), ("b", None), ("c", "")], "doc_id string, content string")
    tx, errors = X.parse_transactions(df)
    assert tx.count() == 0 and errors.count() == 3


def test_a_large_file_read_in_splits(spark, tmp_path):
    segs = ["ISA", *["ST", "BIG", "SE"] * 3000, "IEA"]
    (tmp_path / "big.edi").write_text("~".join(f"{s}*{i}" for i, s in enumerate(segs)) + "~")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = X.read_large(spark, str(tmp_path / "big.edi"), "~", "*")
        assert rows.rdd.getNumPartitions() > 1
        tx = X.transactions_of_large(rows)
        got = tx.groupBy("tx_index").agg(F.min("seg_pos").alias("a"), F.max("seg_pos").alias("b")).orderBy("tx_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.tx_index, r.a, r.b) for r in got] == [(i, 3 * i + 1, 3 * i + 3) for i in range(3000)]


def test_keys_filled_across_tasks_equal_the_window(spark):
    r = random.Random(1)
    rows = [(f"p{0 if r.random() < 0.7 else i % 5}", i, r.choice(["HDR", "DTL", "DTL"]), r.choice(["k", None, f"x{i}"]), f"own{i}")
            for i in range(500)]
    df = spark.createDataFrame(rows, "path string, line_no int, rid string, key string, own string")
    by_window = df.withColumn("k", D.fill_forward_key(df, F.col("rid") == "HDR", F.col("key"), F.col("own")))
    carried = D.filled_forward(df, F.col("rid") == "HDR", F.col("key"), F.col("own"), name="k")
    assert sorted(map(repr, by_window.collect())) == sorted(map(repr, carried.collect()))
