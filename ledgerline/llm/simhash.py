"""SimHash near-duplicates by a Gray-order hierarchical index of the fingerprints.

1. A fingerprint for each document: 64 counters over the XXH64 values of its word shingles.
   Equal fingerprints are one node from here on, however many documents share one.
2. Upper index nodes are masked bit patterns.  A node of over ``LEAF`` fingerprints hands
   them down to four families of children: the bits that still vary are dealt into four
   masks by how evenly they vary, and a child holds the fingerprints that agree on one mask.
   Two fingerprints that differ in three bits or fewer agree on one of the four, so no link
   is lost; nodes are split again until they are small.
3. Within a small node the fingerprints are sorted by Gray rank, which brings alike ones
   together.  Runs of ``FAN`` become tree nodes, each with the bits on which all its
   fingerprints agree; a search goes down from the root, adds the differing bits that a level
   fixes anew to those so far, and leaves out every subtree whose sum is over the limit, or
   whose fingerprints are all joined to the searcher already.
4. Each node gives a spanning forest of its links, never all pairs; components follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.shared import join_skewed, ready, utf8, write_through

SEED = 42
DISTANCE = 3
#: Fingerprints of one lowest node; fingerprints under one node of its tree.
LEAF, FAN = 4096, 8
#: Shingles hashed at a time; pairs of searcher and fingerprint looked at together at most.
_STEP, _TOGETHER = 1 << 15, 1 << 20


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is set when over half of the shingles' hashes have it; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:][:n]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        cuts = map(line.__getitem__, map(slice, starts[at:min(at + _STEP, n)].tolist(), last[at:at + _STEP].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray order: x ^ x>>1 ^ x>>2 and so on."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Fingerprints of several groups, each a tree over its Gray order, level by level."""

    def __init__(self, groups: np.ndarray, prints: np.ndarray):
        order = np.lexsort((gray_rank(prints), groups))
        self.order, self.prints, groups = order, prints[order], groups[order]
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.sizes = np.diff(np.concatenate([first, [len(groups)]]))
        self.first, self.group = first, np.repeat(np.arange(len(first)), self.sizes)
        #: from the lowest nodes up: (first leaf, end, agreed bits, pattern, first node of each group)
        self.levels = []
        sizes, span = self.sizes, 1
        while not self.levels or sizes.max(initial=0) > 1:
            span *= FAN
            sizes = -(-sizes // FAN)
            base = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            start = first[owner] + (np.arange(base[-1]) - base[owner]) * span
            end = np.minimum(start + span, (first + self.sizes)[owner])
            ones, some = (f.reduceat(self.prints, start) for f in (np.bitwise_and, np.bitwise_or))
            self.levels.append((start, end, ~(ones ^ some), ones, base[:-1]))

    def forest(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (two arrays of places in the input) that join what lies within ``distance``."""
        label = np.arange(len(self.prints))
        reach = np.cumsum(self.sizes[self.group])
        at = 0
        while at < len(label):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _TOGETHER, "right")))
            i, j = self._search(np.arange(at, end), label, distance)
            label = _joined(label, i, j)
            at = end
        other = np.flatnonzero(label != np.arange(len(label)))
        return self.order[other], self.order[label[other]]

    def _search(self, asked: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of the asked ones with what lies within ``distance``, without
        those that their subtree's common label shows to be joined."""
        top = self.levels[-1][4][self.group[asked]]
        who, node, sums = asked, top, np.zeros(len(asked), np.int64)
        fixed_above = np.zeros(len(asked), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            start, end, fixed, pattern, _ = self.levels[depth]
            low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
            sums = sums + np.bitwise_count((self.prints[who] ^ pattern[node]) & fixed[node] & ~fixed_above)
            left = (sums <= distance) & (end[node] > who + 1) & ~(
                (low[node] == high[node]) & (low[node] == label[who]))
            who, node, sums = who[left], node[left], sums[left]
            fixed_above = fixed[node]
            # down: the nodes of the next level, or the leaves
            if depth:
                below = self.levels[depth - 1][0]
                a = np.searchsorted(below, start[node])
                b = np.searchsorted(below, end[node])
            else:
                a, b = start[node], end[node]
            n = b - a
            who, sums, fixed_above = (np.repeat(x, n) for x in (who, sums, fixed_above))
            node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        near = (node > who) & (np.bitwise_count(self.prints[who] ^ self.prints[node]) <= distance)
        return who[near], node[near]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest place of what is joined) after the links (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def fingerprints(df: DataFrame, text_col: str, keep: dict[str, str], width: int = 3) -> DataFrame:
    """The columns of ``keep`` (new name: column) and ``fp`` (signed 64 bits), row by row."""
    ready(df.sparkSession)
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, width) for t in utf8(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))],
                                             names=[*b.schema.names[:-1], "fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "fp long"])).select(
        *[F.col(f"k_{n}").alias(n) for n in keep], "fp")


def _bit(b: int | Column) -> Column:
    return F.shiftright("fp", b).bitwiseAND(F.lit(1))


def _every_fourth(k: int) -> Callable[[Column, Column], Column]:
    return lambda _, i: i % 4 == k


def _split(nodes: DataFrame) -> DataFrame:
    """The rows (node, fp) under four children of their nodes each.

    Of each node the varying bits, most even first, are dealt to four masks in turn."""
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(_bit(b)) for b in range(64)]).alias("ones"))
    uneven = F.transform("ones", lambda c, b: F.struct(F.abs(2 * c - F.col("n")).alias("by"), b.alias("bit"), c.alias("c")))
    varying = F.array_sort(F.filter(uneven, lambda s: (s["c"] > 0) & (s["c"] < F.col("n"))))
    masks = counts.select("node", varying.alias("bits")).select("node", F.array(*[
        F.aggregate(F.filter("bits", _every_fourth(k)), F.lit(0).cast("long"),
                    lambda m, s: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["bit"]))) for k in range(4)]).alias("masks"))
    return join_skewed(nodes, masks, ["node"]).select(
        "node", "fp", F.posexplode("masks").alias("k", "mask")).select(
        F.xxhash64("node", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp")


def _forests(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the small nodes (node, fp), one tree for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def links(block: np.ndarray) -> pa.RecordBatch:
            prints = block[1].view(np.uint64)
            i, j = GrayIndex(block[0], prints).forest(DISTANCE) if len(prints) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(block[1][i]), pa.array(block[1][j])], names=["a", "b"])

        for b in batches:
            held.append(np.array([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            rows += b.num_rows
            if rows >= 1 << 16:
                block = np.concatenate(held, axis=1)
                open_from = int(np.searchsorted(block[0], block[0, -1])) if len(block[0]) else 0
                held, rows = [block[:, open_from:]], block.shape[1] - open_from
                yield links(block[:, :open_from])
        if held:
            yield links(np.concatenate(held, axis=1))

    # rows are two longs: a node of LEAF fingerprints is small, and tasks get whole nodes
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column ``fp``) that join all within three bits.

    A node that is too large is split by its varying bits; distinct fingerprints have at
    least 13 of these then, and children have a quarter fewer, so splitting ends."""
    nodes = prints.select(F.lit(0).cast("long").alias("node"), "fp")
    links, level = None, 0
    while True:
        large = write_through(nodes.groupBy("node").count().where(F.col("count") > LEAF).select("node"), "simhash-large")
        n_large = large.count()
        small = nodes if not n_large else nodes.join(large, "node", "left_anti") if level else None
        if small is not None:
            found = write_through(_forests(small), "simhash-links")
            links = found if links is None else links.unionByName(found)
        if not n_large:
            return links
        nodes = write_through(_split(nodes if not level else join_skewed(nodes, large, ["node"])), "simhash-nodes")
        level += 1


def near_documents(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``df``.

    ``fingerprint``: 16 hexadecimal digits.  Documents whose fingerprints differ in three
    bits or fewer are linked; ``component_id`` is the smallest id reachable by links, the own
    one included.

    Null and empty texts, and those without words, have the fingerprint zero and are linked
    like others; very long texts are hashed some shingles at a time.  Repeated rows, and rows
    of one id, are documents of their own: each has its text's result.  A row without an id
    links others but names no component (null, if nothing reachable has an id).  An empty table
    gives no rows; other columns take no part."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = write_through(fingerprints(docs, "text", {"id": "id"}, width), "simhash")
    prints = write_through(docs.groupBy("fp").agg(F.min("id").alias("first")), "simhash-prints")
    joined = components(near_links(prints.select("fp")))
    named = prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = join_skewed(named.select("fp", "component"), least, ["component"]).select("fp", "component_id")
    return join_skewed(docs, classes, ["fp"]).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
