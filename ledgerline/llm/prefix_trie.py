"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of its ends; only the
smallest of each group goes on.  Sequences that are a proper prefix of another are found by an
anti-join, which leaves the leaves.  Each node is then an aggregate over the weighted
sequences that pass through it, one row for each (sequence, depth), never for pairs of nodes.

A prefix is named by its depth and the exclusive or of 2 x 64 hash bits of its (place, role,
text) rows, so prefixes are running values and long conversations need no single task
(:mod:`ledgerline.carry`).

Saved tokens of a subtree are its members' bytes less its nodes' own bytes.  Members' bytes are
the weighted sequences' remaining bytes; nodes' own bytes are counted by giving each node to
the smallest leaf sequence through it: a sequence owns its nodes from some depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.carry import AT, Fold, in_order, running
from ledgerline.llm.shared import join_skewed, ready, rows_of, write_through

FAMILY, HEADS = 5, 9
NODE = ["depth", "p1", "p2"]
#: Ids of one part of an end list.
ENDS = 4096


def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, place, y1, y2, bytes) of every row: its place in its conversation from 1,
    two hashes of role and text, and the text's UTF-8 bytes.  Rows are taken by turn, null
    first, rows of one turn by role and text; null roles and texts are empty; rows without a
    conv_id belong to no conversation."""
    ready(df.sparkSession)
    own_role, own_text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), own_role.alias("role"),
                     own_text.alias("text")).where("conv_id is not null")
    rows = rows.select("*", F.xxhash64(F.lit(1), "role", "text").alias("y1"), F.xxhash64(F.lit(2), "text", "role").alias("y2"),
                       F.octet_length("text").cast("long").alias("bytes"))
    placed = in_order(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"),
                      keep=["conv_id", "y1", "y2", "bytes"])
    return write_through(running(placed, ["conv_id"], place=Fold("count")).drop(AT), "trie-turns")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations, and a row of place 0 for each conversation: the
    first h turns of conversation c - c % 5, then c's own turns after its first h, where h is
    the unsigned crc32 of c as decimal text, mod 9."""
    convs = write_through(turns.select("conv_id").distinct(), "trie-convs")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    heads = turns.where(F.col("place") < HEADS).select(F.col("conv_id").alias("base"), "place", "y1", "y2", "bytes")
    asked = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    # at most eight heads and five askers for each base
    taken = write_through(asked.join(heads, "base").where("place <= h").select("conv_id", "place", "y1", "y2", "bytes"), "trie-heads")
    used = asked.join(taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("used")), "conv_id", "left").select(
        "conv_id", (F.coalesce("used", F.lit(0)) - F.col("h")).alias("shift"))
    own = join_skewed(turns.where(F.col("place") > h), used, ["conv_id"]).select(
        "conv_id", (F.col("place") + F.col("shift")).alias("place"), "y1", "y2", "bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("place"), zero.alias("y1"), zero.alias("y2"), zero.alias("bytes"))
    return taken.unionByName(own).unionByName(roots)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, x1, x2, bytes, upto) for each prefix of each conversation of
    ``turns`` (which has a row of place 0): its name, what its last row adds to the name, that
    row's bytes, and the bytes so far."""
    def hashed(y: str) -> Column:
        return F.when(F.col("place") > 0, F.xxhash64("place", y)).otherwise(F.lit(0).cast("long"))

    rows = turns.select("conv_id", "place", hashed("y1").alias("x1"), hashed("y2").alias("x2"), "bytes")
    placed = in_order(rows, "conv_id", "place")
    folded = running(placed, ["conv_id"], p1=Fold("xor", F.col("x1")), p2=Fold("xor", F.col("x2")),
                     upto=Fold("sum", F.col("bytes")))
    return folded.withColumnRenamed("place", "depth").drop(AT)


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the rows (depth, p1, p2, conv_id): the hash of each
    node's ids, ascending and comma-joined.  Ids are joined in parts where they lie sorted;
    only the parts of a node, ``ENDS`` ids each, stream through one hash."""
    keys = [("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64())]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for columns in rows_of(batches, *NODE, "conv_id"):
            done = []
            for *node, c in zip(*columns):
                if now is not None and (node != now or len(ids) >= ENDS):
                    done.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = node
                ids.append(c)
            yield of_rows(done)
        yield of_rows([(*now, ids[0], ",".join(map(str, ids)))] if ids else [])

    def of_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [*keys, ("first", pa.int64()), ("ids", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal done
            columns, done = list(zip(*done)) or [[]] * 4, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[t for _, t in keys], pa.string()])],
                                              names=[*NODE, "ends_sha256"])

        for columns in rows_of(batches, *NODE, "ids"):
            for *node, ids in zip(*columns):
                if node != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield flush()
        if now is not None:
            done.append((*now, digest.hexdigest()))
        yield flush()

    joined = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(
        *NODE, "conv_id").mapInArrow(parts, "depth long, p1 long, p2 long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        hashes, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie over the conversations of ``turns`` (conv_id, place,
    y1, y2, bytes; place 0 for each, as of :func:`with_shared_heads`): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns end at the root; identical ones are one sequence with a
    weight; very long ones are cut over tasks; an empty table gives no rows."""
    paths = write_through(prefixes(turns), "trie-paths")
    lengths = paths.groupBy("conv_id").agg(F.max(F.struct(*NODE, "upto")).alias("end"))
    whole = write_through(lengths.select("conv_id", *[F.col("end")[k].alias(k) for k in NODE], F.col("end")["upto"].alias("total")),
                          "trie-whole")
    sequences = write_through(whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"),
                                                       F.first("total").alias("total")), "trie-sequences")
    firsts = join_skewed(paths, sequences.select("conv_id", F.col("depth").alias("length"), "weight", "total"), ["conv_id"])
    firsts = write_through(firsts, "trie-firsts")
    inner = firsts.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    leaves = write_through(leaves, "trie-leaves")
    of_leaves = join_skewed(firsts, leaves, ["conv_id"])

    # bytes at or behind a depth: all less those before its last row; the root has none
    behind = F.col("total") - F.col("upto") + F.col("bytes")
    passed = firsts.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * behind).alias("member_bytes"),
        F.min("x1").alias("x1"), F.min("x2").alias("x2"))
    ends = of_leaves.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_leaves"))
    nodes = write_through(passed.join(ends, NODE), "trie-nodes")

    # a leaf sequence owns its nodes from its least owned depth on, so it counts bytes from there
    owned = nodes.groupBy("owner").agg(F.min("depth").alias("own_depth")).withColumnRenamed("owner", "conv_id")
    own = write_through(owned, "trie-owned")
    with_own = write_through(join_skewed(of_leaves, own, ["conv_id"]), "trie-leaf-paths")
    from_own = with_own.where("depth = own_depth").select("conv_id", behind.alias("own_bytes"))
    counted = join_skewed(with_own, from_own, ["conv_id"]).groupBy(*NODE).agg(
        F.sum(F.least(behind, F.col("own_bytes"))).alias("node_bytes"))

    parents = nodes.where("depth > 0").select(
        *NODE, (F.col("depth") - 1).alias("d0"), F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))
    children = parents.groupBy(F.col("d0").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("depth").alias("d0"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                         F.col("conv_id").alias("parent_conv_id"))
    parents = join_skewed(write_through(parents, "trie-parents"), above, ["d0", "q1", "q2"]).select(*NODE, "parent_conv_id")
    listed = end_lists(whole)
    out = (nodes.join(counted, NODE).join(parents, NODE, "left").join(children, NODE, "left").join(listed, NODE, "left"))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                      "n_leaves", (F.col("member_bytes") - F.col("node_bytes")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
