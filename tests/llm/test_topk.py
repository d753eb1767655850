import math
import random

from ledgerline.llm import topk
from pyspark.sql import functions as F


def plain(rows, k, scale=256):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(scale * x) for x in v])
    out = []
    for q in sorted(i for i in ok if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q][0], v)), i) for i in ok if i != q for v in ok[i])
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))


def search(df, **options):
    return sorted(tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("id") % 10 == 0, **options).collect())


def test_equals_every_product(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) * rnd.choice([0.1, 1, 3]) for _ in range(8)]) for i in range(400)]
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    want = plain([(r.vec_id, r.embedding) for r in frame(spark, rows).collect()], 5)
    assert search(frame(spark, rows)) == want
    monkeypatch.setattr(topk, "BLOCK_BYTES", 512)  # many blocks, several blocks of queries
    assert search(frame(spark, rows), query_bytes=512) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.25]),
            (7, []), (8, [0.5]), (None, [1.0, 1.0]), (10, [-1.0, -1.0]), (20, None), (6, [0.5, 0.25])]
    want = plain([(r.vec_id, r.embedding) for r in frame(spark, rows).collect()], 3)
    assert search(frame(spark, rows), k=3) == want
    assert [r[2] for r in want if r[0] == 0] == [5, 6, 6]  # ties go to the smaller id
    assert search(frame(spark, rows).where("false")) == []
    assert search(frame(spark, rows[:1])) == []
