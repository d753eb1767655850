"""N-gram Jaccard join by PartEnum signatures: documents link when their sets of word
shingles overlap enough; the result is each document's class.

1. Copies first: one representative of each distinct text goes on, so a group of copies,
   however large, is one set.
2. Signatures (:mod:`partenum`): sufficiently similar sets share one.  Rows (signature,
   document) are shuffled and sorted by signature, and a streaming pass turns each bucket
   into pairs.  A bucket of over ``MOST`` documents gives no pairs: its documents go to a
   second round, as do the few sets that left out too many signatures.
3. A pair is a candidate when it shares as many parts as the pigeonhole promises.
4. Second round, with longer signatures: small buckets give pairs again; documents of large
   buckets are joined to clusters, and a cluster is compared in blocks of ``BLOCK`` by
   matrix products, which give links and no rows for pairs.
5. Every candidate is verified on whole sets; components follow from the links.

Nothing is left out at any size; ids alone are broadcast, and only up to ``BROADCAST_IDS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.partenum import BAND_BITS, PART_BITS, Scheme, shingles, verified_links
from ledgerline.llm.shared import ready, utf8, write_through

#: A bucket's largest number of documents that are paired.  Near copies share most of their
#: buckets, and in each a document has half of this many pairs: at 12 that is about as many
#: rows as the second round's signatures of the document.  The result is the same at any value.
MOST = 12
#: Ids of one task's forest; more are told in several forests.
FOREST = 200_000
BLOCK, BROADCAST_IDS = 256, 1_000_000
#: Features of one block of a cluster, on average at most (8 bytes each).
BLOCK_FEATURES = 1 << 19

#: Signature rows of one Arrow batch (24 bytes each; and one document more): a text gives hundreds,
#: a set in the second round thousands, so a batch of documents gives many times its own bytes.
SIGNED_ROWS = 1 << 16

SIGNED = "sig long, id long, n int, need int"
EVENTS = "kind string, a long, b long, part int, need int"


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose id is (or is not) in ``ids``: by broadcast while the ids are few, so no
    text moves; else by a shuffle, with the ids as the hashed side."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "id", how)


def sets_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The feature sets of a column, without a Python object for each feature."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def signed(rows: DataFrame, scheme: Scheme, width: int) -> DataFrame:
    """Signature rows of texts, or of sets that are there already; rows with ``n`` < 0 are
    notes: -1 the size of a set (in ``need``), -2 an unsafe set."""
    of_texts = "text" in rows.columns

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(
            zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["sig", "id", "n", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            sets = (shingles(t, width) for t in utf8(batch.column("text"))) if of_texts else sets_of(batch.column("features"))
            for doc, features in zip(batch.column("id").to_pylist(), sets):
                own, need, unsafe = scheme.signatures(features) if len(features) else (
                    np.zeros(0, np.uint64), np.zeros(0, np.int32), False)
                notes = [(-1, len(features))] * of_texts + [(-2, 0)] * unsafe
                found.append((np.concatenate([own.view(np.int64), np.full(len(notes), doc, np.int64)]),
                              np.full(len(own) + len(notes), doc, np.int64),
                              np.concatenate([np.full(len(own), len(features)), [x for x, _ in notes]]),
                              np.concatenate([need, [x for _, x in notes]])))
                held += len(own) + len(notes)
                if held >= SIGNED_ROWS:
                    yield batch_of(found)
                    found, held = [], 0
            if found:
                yield batch_of(found)

    return rows.mapInArrow(run, SIGNED)


_EVENT_SCHEMA = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()),
                           ("need", pa.int32())])


class _Buckets:
    """Walks rows sorted by signature.  Of the open bucket it holds ``MOST`` rows at most; of
    the large ones a forest over ``FOREST`` ids at most, which says what they join."""

    def __init__(self, percent: int, stars: bool):
        self.scheme, self.stars = Scheme(percent), stars
        self.sig, self.held, self.first, self.rows = None, [], None, []
        self.root: dict[int, int] = {}

    def top(self, doc: int) -> int:
        root = self.root
        while (up := root.setdefault(doc, doc)) != doc:
            root[doc] = root[up]
            doc = up
        return doc

    def tell_stars(self) -> None:
        """A link from every id to the smallest that it is joined to; the forest is emptied."""
        for doc in list(self.root):
            if (least := self.top(doc)) != doc:
                self.say("star", least, doc)
        self.root = {}

    def say(self, kind: str, a: int, b: int | None = None, part: int | None = None, need: int | None = None) -> None:
        self.rows.append((kind, a, b, part, need))

    def hot(self, doc: int) -> None:
        self.say("hot", doc)
        if self.stars and doc != self.first:
            a, b = self.top(self.first), self.top(doc)
            self.root[max(a, b)] = min(a, b)
            if len(self.root) >= FOREST:
                self.tell_stars()

    def close(self) -> None:
        """Pairs of the open bucket, if it stayed small.  A pair counts under the band of its
        larger set."""
        name = (self.sig or 0) & (1 << BAND_BITS + PART_BITS) - 1
        band, part = name >> PART_BITS, name & (1 << PART_BITS) - 1
        for j, (b, nb, need_b) in enumerate(self.held):
            for a, na, need_a in self.held[:j]:
                small, large = min(na, nb), max(na, nb)
                if 100 * small >= self.scheme.percent * large and self.scheme.band(large) % (1 << BAND_BITS) == band:
                    self.say("pair", min(a, b), max(a, b), part, max(need_a, need_b))
        self.held, self.first = [], None

    def take(self, sig: int, doc: int, n: int, need: int) -> None:
        if sig != self.sig:
            self.close()
            self.sig = sig
        if self.first is not None:
            self.hot(doc)
        elif not self.held or self.held[-1][0] != doc:  # a repeated row adds nothing
            self.held.append((doc, n, need))
            if len(self.held) > MOST:
                self.first = self.held[0][0]
                for doc, _, _ in self.held:
                    self.hot(doc)
                self.held = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EVENT_SCHEMA)],
                                          schema=_EVENT_SCHEMA)


def bucket_events(rows: DataFrame, percent: int, stars: bool) -> DataFrame:
    """Pairs of small buckets (kind ``pair``), documents of large ones (``hot``; with ``stars``
    also links that join the documents of a bucket, ``star``, one or so for each task and
    document), unsafe sets (``hot``) and sizes (``size``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(percent, stars)
        for batch in batches:
            sig, ids, n, need = (batch.column(i).to_numpy() for i in range(4))
            for i in np.flatnonzero(n < 0).tolist():
                buckets.say("size" if n[i] == -1 else "hot", int(ids[i]), need=int(need[i]))
            sig, ids, n, need = (x[n >= 0] for x in (sig, ids, n, need))
            # rows that share their signature with a neighbour, or that may go on
            same = np.zeros(len(sig) + 1, bool)
            same[1:-1] = sig[1:] == sig[:-1]
            same = same[1:] | same[:-1]
            if len(sig):
                same[0] |= int(sig[0]) == buckets.sig
                same[-1] = True
            for row in zip(*(x[same].tolist() for x in (sig, ids, n, need))):
                buckets.take(*row)
            yield buckets.batch()
        buckets.close()
        buckets.tell_stars()
        yield buckets.batch()

    return rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, EVENTS)


def feature_sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, w, features) of rows (id, w, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width).view(np.int64) for t in utf8(batch.column("text"))]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("w"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["id", "w", "features"])

    return rows.select("id", "w", "text").mapInArrow(run, "id long, w long, features array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, with the copies that each side stands for (wa, wb)."""
    sides = [sets.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"), F.col("features").alias(f"f{x}"))
             for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.withColumn("shared", F.size(F.array_intersect("fa", "fb")))
    return both.where(100 * F.col("shared") >= percent * (F.size("fa") + F.size("fb") - F.col("shared"))).select(
        "a", "b", "wa", "wb")


def cluster_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within clusters (node, component), block against block: rows ``link`` (a, b)
    that join what is linked (no cycle within two blocks) and rows ``count`` (a, n) with the
    copies that a document links to."""
    lengths = sets.select(F.col("id").alias("node"), F.size("features").alias("n"))
    sizes = clusters.join(lengths, "node").groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_FEATURES)).cast("int").alias("blocks"))
    placed = (clusters.join(sizes, "component")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .join(sets, F.col("node") == F.col("id"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      "block", "id", "w", "features"))

    def run(key, group):
        low, high = key[1].as_py(), key[2].as_py()
        block = group.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        group, first = group.take(order), int((block == low).sum())
        ids, w = group.column("id").to_pylist(), group.column("w").to_pylist()
        sets = sets_of(group.column("features"))
        found = verified_links(sets, None, percent) if low == high else verified_links(
            sets[:first], sets[first:], percent)
        root, counts, rows = list(range(len(ids))), [0] * len(ids), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in found:
            counts[i] += w[j]
            counts[j] += w[i]
            if (a := top(i)) != (b := top(j)):
                root[a] = b
                rows.append(("link", ids[i], ids[j]))
        rows += [("count", d, n) for d, n in zip(ids, counts) if n]
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                        names=["kind", "a", "b"])

    return placed.groupBy("component", "low", "high").applyInArrow(run, "kind string, a long, b long")


def near_classes(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of ``df``.

    Sets are the distinct shingles of ``width`` words (of all words, if fewer); two documents
    link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    reachable by links, the own one included; ``n_links`` counts the documents linked to.

    Null and empty texts have no shingles and link with nothing.  Rows of a null id have
    null results.  Ids name documents: rows of one id count as one node, and where their
    texts differ ``n_shingles`` is the largest.  An empty table gives no rows; other columns
    take no part."""
    spark = df.sparkSession
    ready(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = docs.where("id is not null")
    keys = named.select("id", F.md5(F.col("text").cast("binary")).alias("key"))
    same = write_through(keys.distinct().groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "copies")
    members = keys.join(same, "key")
    # an id may come with several texts: it is a copy when none of them is the first of its kind
    copies = members.where("id <> rep").select("id").distinct().join(
        same.select(F.col("rep").alias("id")), "id", "left_anti")
    copies = write_through(copies, "copies")
    firsts = only(named, copies, "left_anti")
    events = write_through(bucket_events(signed(firsts, Scheme(percent), width), percent, False), "near-events")

    pairs = _candidates(events)
    hot = write_through(events.where("kind = 'hot'").select(F.col("a").alias("id")).distinct(), "near-hot")
    pairs = write_through(pairs, "near-pairs")
    asked = write_through(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
                          .unionByName(hot).distinct(), "near-asked")
    weighed = only(firsts, asked).join(same.where("w > 1").select(F.col("rep").alias("id"), "w"), "id", "left")
    sets = write_through(feature_sets(weighed.withColumn("w", F.coalesce("w", F.lit(1).cast("long"))), width), "near-sets")

    second = write_through(bucket_events(signed(only(sets, hot), Scheme(percent, 1, True), width), percent, True),
                           "near-events")
    clusters = write_through(components(second.where("kind = 'star'").select("a", "b")), "near-clusters")
    within = write_through(cluster_links(clusters, sets, percent), "near-links")
    pairs = pairs.unionByName(_candidates(second)).distinct()
    # pairs within one cluster are compared there
    in_a, in_b = (clusters.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    pairs = pairs.join(in_a, "a", "left").join(in_b, "b", "left").where("ca is null or cb is null or ca <> cb")
    links = write_through(verified(pairs.select("a", "b"), sets, percent), "near-links")

    counts = (within.where("kind = 'count'").select("a", F.col("b").alias("n"))
              .unionByName(links.select("a", F.col("wb").alias("n")))
              .unionByName(links.select(F.col("b").alias("a"), F.col("wa").alias("n")))
              .groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others")))
    classes = components(within.where("kind = 'link'").select("a", "b").unionByName(links.select("a", "b")))
    sizes = events.where("kind = 'size'").groupBy(F.col("a").alias("rep")).agg(F.max("need").cast("long").alias("n_shingles"))
    about = (same.join(sizes, "rep").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .join(counts, "rep", "left"))
    found = (keys.join(about, "key").groupBy("id").agg(  # one row for each id
        F.max("n_shingles").alias("n_shingles"), F.min(F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep"))
                                                       .otherwise(F.col("id"))).alias("component_id"),
        F.max(F.coalesce("others", F.lit(0)) + F.when(F.col("n_shingles") > 0, F.col("w") - 1).otherwise(0)).alias("n_links")))
    return docs.select("id").join(found, "id", "left")


def _candidates(events: DataFrame) -> DataFrame:
    """Pairs that share as many parts as the layout promises."""
    return (events.where("kind = 'pair'").groupBy("a", "b")
            .agg(F.count_distinct("part").alias("parts"), F.max("need").alias("need"))
            .where("parts >= need").select("a", "b"))


def one_of_each(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each class, the one of the smallest id.

    A document is a distinct (id, text): texts of one id are compared as documents of their
    own (in the order of their MD5), so a text that is in no other class stays whatever
    happens to the id's other texts.  Repeated rows of one id and text are one document and
    stay or go together.  Rows without an id are compared with each other only, and by their
    whole text: one row of each text stays, whichever, if other columns differ."""
    named = df.where(F.col(id_col).cast("long").isNotNull())
    unnamed = df.where(F.col(id_col).cast("long").isNull()).dropDuplicates([text_col])
    several = named.groupBy(F.col(id_col).cast("long")).count().where("count > 1")
    if several.isEmpty():  # ids name documents
        found = near_classes(named, id_col, text_col, width, percent).where("id <> component_id").select(
            F.col("id").alias(id_col)).distinct()
        return named.join(found, id_col, "left_anti").select(df.columns).unionByName(unnamed)
    own, key = F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    docs = named.select(own.alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    # numbered in the order of ids, so the smallest number of a class has its smallest id
    nodes = write_through(docs.select("id", "key").distinct().orderBy("id", "key")
                          .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    classes = near_classes(docs.join(nodes, ["id", "key"]), "node", "text", width, percent)
    found = (nodes.join(classes.where("id <> component_id").select(F.col("id").alias("node")).distinct(), "node")
             .select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")))
    return named.join(found, (own == F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti").unionByName(unnamed)
