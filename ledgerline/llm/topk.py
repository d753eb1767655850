"""Exact top-k inner products of a query set against all vectors.

Vectors become integers, floor(scale * x).  They are range-partitioned by descending length
and packed into blocks, each with its longest length.  Queries go in blocks of bounded
size: a block is broadcast, and every task walks its vector blocks in descending length.

For a query q and a vector v, q.v <= |q| |v|, so once |q| times the block's longest length
falls under the query's k-th best score, the query is done with the task.  Otherwise both
are rotated (right singular vectors of a bounded sample, so the first coordinates hold most
of the length), the product of the first ``head`` coordinates is computed exactly for the
whole block, and the rest is bounded by the product of the residual lengths
(Cauchy-Schwarz).  Only pairs whose bound reaches the k-th best get the integer product.
The rotation only affects speed: a rounding margin keeps every pair that could count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import ready, write_through

#: Bytes of a packed block of vectors, rows of the rotation's sample, bytes of a query block.
BLOCK_BYTES, SAMPLE_ROWS, QUERY_BYTES = 1 << 17, 4096, 4 << 20
#: Blocks of the longest vectors that give every query its first threshold.
SEED_BLOCKS = 8
_MARGIN = 1e-9


def usable(vector: Column) -> Column:
    """Not null and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, norm2) of the rows that take part; null ids take no part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def padded(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of int64, shorter ones filled with zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dims).all():
        return flat[ends[0]:ends[-1]].reshape(-1, dims).astype(np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def pack(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks (longest, ids, vectors) of (id, v, norm2) rows, by descending length."""
    per_block = max(1, BLOCK_BYTES // (8 * max(1, dims)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, per_block):
                s = b.slice(at, per_block)
                ids, v = s.column("id").to_numpy(), padded(s.column("v"), dims)
                yield pa.RecordBatch.from_pydict({
                    "longest": pa.array([float(np.sqrt(s.column("norm2")[0].as_py()))]),
                    "ids": pa.array([ids.astype("<i8").tobytes()]), "vectors": pa.array([v.astype("<i8").tobytes()])})

    order = [F.col("norm2").desc(), F.col("id")]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(packed, "longest double, ids binary, vectors binary"))


def opened(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), dims)


class Search:
    """The k best of one block of queries, fed with blocks of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, head: int):
        self.ids, self.vectors, self.rotation, self.k, self.head = ids, vectors, rotation, k, head
        self.turned = vectors @ rotation
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.rest = np.linalg.norm(self.turned[:, head:], axis=1)
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score so far
        self.best = np.zeros((0, 3), np.int64)   # query, vector id, score

    def exact(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Integer products of paired rows."""
        return np.einsum("ij,ij->i", q, v)

    def feed(self, longest: float, ids: np.ndarray, vectors: np.ndarray) -> bool:
        """False when no query can gain from this block or any shorter one."""
        asked = np.flatnonzero(self.norms * longest * (1 + _MARGIN) + _MARGIN >= self.floor)
        if not len(asked):
            return False
        turned = vectors @ self.rotation
        rest = np.linalg.norm(turned[:, self.head:], axis=1)
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        bound = self.turned[asked, :self.head] @ turned[:, :self.head].T
        bound += np.outer(self.rest[asked], rest)
        bound += _MARGIN * np.outer(self.norms[asked], norms) + _MARGIN
        q, v = np.nonzero(bound >= self.floor[asked, None])
        q = asked[q]
        other = self.ids[q] != ids[v]
        q, v = q[other], v[other]
        for at in range(0, len(q), 1 << 18):  # pairs at a time: bounded memory
            a, b = q[at:at + (1 << 18)], v[at:at + (1 << 18)]
            score = self.exact(self.vectors[a], vectors[b])
            self._take(np.stack([a, ids[b], score], axis=1)[score >= self.floor[a]])
        return True

    def _take(self, found: np.ndarray) -> None:
        if not len(found):
            return
        rows = np.concatenate([self.best, found])
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        rank = np.arange(len(rows)) - first
        self.best = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.floor[last[:, 0]] = last[:, 2]


def rotation_of(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of a bounded sample (the rows whose ids hash lowest)."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    x = padded(sample, dims).astype(np.float64)
    return np.linalg.svd(np.concatenate([x, np.zeros((dims, dims))]), full_matrices=False)[2].T


def top_k(df: DataFrame, id_col: str, vector_col: str, queries: Column, k: int = 5, scale: int = 256,
          query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row
    that ``queries`` chooses, against every row but those of its own id; ties go to the
    smaller id.

    Null vectors, null ids and vectors with null or non-finite components take no part;
    shorter vectors count as filled with zeros; repeated rows are candidates each, and a
    repeated query is asked once; fewer than k candidates give fewer rows; an empty table
    gives no rows.  Scores must fit a long."""
    spark = df.sparkSession
    ready(spark)
    rows = integer_vectors(df, id_col, vector_col, scale)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, vec_id long, score long"
    if not dims:
        dims = 1
    blocks = write_through(pack(rows, dims), "vector-blocks")
    asked = rows.where(queries).dropDuplicates(["id"])
    per_block = max(1, query_bytes // (8 * dims))
    n = asked.count()
    # each block of queries has a bounded size: ids are dealt by their hash, and a block is
    # cut where a hash range happens to hold more
    deals = max(1, -(-2 * n // per_block))
    rotation = rotation_of(rows, dims)
    head = max(1, dims // 4)
    seeds = [opened(r, dims) + (r["longest"],) for r in blocks.orderBy(F.col("longest").desc()).limit(SEED_BLOCKS).collect()]
    found = None
    for deal in range(deals):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(deals)) == deal).select("id", "v").toArrow()
        ids, vectors = some.column("id").to_numpy(), padded(some.column("v").combine_chunks(), dims)
        for at in range(0, len(ids), per_block):
            search = Search(ids[at:at + per_block], vectors[at:at + per_block], rotation, k, head)
            for own, v, longest in seeds:
                search.feed(longest, own, v)
            search.best = search.best[:0]  # only the thresholds go along
            part = blocks.mapInArrow(_searched(spark.sparkContext.broadcast(search), dims), schema)
            if deals > 1:
                part = write_through(best_of(part, k), "top-k")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return best_of(found, k).select("query_id", F.row_number().over(_ranked()).alias("rank"), "vec_id", "score")


def _ranked():
    from pyspark.sql import Window
    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")


def best_of(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("_rank", F.row_number().over(_ranked())).where(F.col("_rank") <= k).drop("_rank")


def _searched(shared, dims: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy
        search = copy.copy(shared.value)  # thresholds and answers are this task's own
        search.floor = search.floor.copy()
        for b in batches:
            for row in b.to_pylist():
                search.feed(row["longest"], *opened(row, dims))
        q, vec, score = search.best.T if len(search.best) else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(search.ids[q], pa.int64()),
                                          "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})
    return searched
