"""Benchmark decontamination: a broadcast hash set of the items' word windows, a scan of
each document's windows, verified hits, and removal of the hit spans or documents.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.  An item's
windows are its runs of ``width`` words; an item of fewer words is one window.  A scan
hashes a document's windows with numpy, looks the hashes up, and compares the words of
every hash hit with the item's words, so a hash clash is no hit.

The index is broadcast only within a proven bound: items are dealt into as many blocks as
keep each block under ``block_bytes`` of text, and documents are scanned once per block,
carrying their hits along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import ready, utf8

WIDTH = 13
#: Text bytes of the items of one broadcast block.
BLOCK_BYTES = 4 << 20

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash, mod 2^64, of every run of ``width`` ids."""
    n = len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n]
    return out ^ (out >> np.uint64(29))


class WindowIndex:
    """The windows of one block of items: per width the sorted hashes of the distinct
    windows, a filter over 20 bits of the hash, the words, and the items of each window."""

    FILTER_BITS = 20

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        found: dict[int, dict[bytes, set[int]]] = {}
        for name, text in items:
            words = words_of(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            n = min(width, len(words))
            for i in range(len(words) - n + 1) if n else ():
                found.setdefault(n, {}).setdefault(ids[i:i + n].tobytes(), set()).add(place[name])
        self.widths = {}
        for n, windows in sorted(found.items()):
            ids = np.frombuffer(b"".join(windows), np.uint64).reshape(-1, n)
            hashes = np.array([_hashes(row, n)[0] for row in ids], np.uint64)
            order = np.argsort(hashes, kind="stable")
            holders = [sorted(x) for x in windows.values()]
            filled = np.zeros(1 << self.FILTER_BITS, bool)
            filled[hashes >> np.uint64(64 - self.FILTER_BITS)] = True
            self.widths[n] = (hashes[order], ids[order], [holders[i] for i in order], filled)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurrence of a window (None: none), and the items."""
        ids = np.fromiter(map(self.vocabulary.get, words, (0 for _ in words)), np.uint64, len(words))
        mask, items = None, set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (hashes, windows, holders, filled) in self.widths.items():
            if len(ids) < n:
                continue
            known = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(known):
                continue
            own = _hashes(ids, n)[known]
            near = filled[own >> np.uint64(64 - self.FILTER_BITS)]
            for p, h in zip(known[near].tolist(), own[near]):
                k = int(np.searchsorted(hashes, h))
                while k < len(hashes) and hashes[k] == h:
                    if np.array_equal(windows[k], ids[p:p + n]):
                        mask = np.zeros(len(ids), bool) if mask is None else mask
                        mask[p:p + n] = True
                        items.update(holders[k])
                        break
                    k += 1
        return mask, {self.names[i] for i in items}


def runs_of(mask: np.ndarray) -> list[int]:
    """Start and end of each run of True, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


def cut(text: bytes, runs: list[int]) -> bytes:
    """``text`` without the words of the runs, from each run's first to its last character."""
    places = [m.span() for m in _WORD.finditer(text.translate(_WORD_BYTES))]
    out, at = [], 0
    for start, end in zip(runs[::2], runs[1::2]):
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES,
              width: int = WIDTH) -> Iterator[WindowIndex]:
    """The items' windows, block by block.  An item of over ``block_bytes`` is a block of
    its own; items without words, or null, have no windows; items of one id count as one."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_bytes // 2)))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        found = [(r.id or "", r.text.encode()) for r in part.toLocalIterator()]
        if found or n == 1:
            yield WindowIndex(found, width)


def scan(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str,
         keep: dict[str, str], cleaned: bool = False, block_bytes: int = BLOCK_BYTES,
         width: int = WIDTH) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` (new name: column), ``n_words``,
    ``n_hit``, ``items`` (ids of the items with occurring windows, sorted) and, if
    ``cleaned``, ``text`` without its hit spans.

    A null text has no words (and stays null); empty tables give no rows, empty items no
    hits; repeated rows are rows of their own; other columns take no part."""
    spark = df.sparkSession
    ready(spark)
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("text"),
                     F.lit(0).alias("n_words"), F.array().cast("array<int>").alias("runs"),
                     F.array().cast("array<string>").alias("items"))
    blocks = blocks_of(items, item_id, item_text, block_bytes, width)
    index = next(blocks)
    while index:
        following = next(blocks, None)
        texts = cleaned or following is not None  # the last pass need not give the texts back
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(index), texts), rows.schema)
        index = following
    if cleaned:
        rows = rows.mapInArrow(_cut_rows, rows.schema)
    runs = F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return rows.select(*[F.col(f"k_{n}").alias(n) for n in keep], F.col("n_words").cast("long").alias("n_words"),
                       F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
                       "items", *(["text"] if cleaned else []))


def _pass(index, texts: bool):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, items = [], [], []
            before = zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist())
            for text, (old_runs, old_items) in zip(utf8(batch.column("text")), before):
                words = words_of(text)
                mask, found = index.value.hits(words)
                if mask is not None:
                    for start, end in zip(old_runs[::2], old_runs[1::2]):
                        mask[start:end] = True
                n_words.append(len(words))
                runs.append(old_runs if mask is None else runs_of(mask))
                items.append(sorted({*old_items, *found}) if found else old_items)
            new = {"n_words": n_words, "runs": runs, "items": items}
            if not texts:
                new["text"] = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else batch.column(i)
                 for i, f in enumerate(batch.schema)], schema=batch.schema)
    return scanned


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [cut(t.encode(), runs).decode() if runs else t
                 for t, runs in zip(batch.column(at).to_pylist(), batch.column("runs").to_pylist())]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def contaminated(n_hit: Column | None = None, n_words: Column | None = None) -> Column:
    """At least one word in 20 lies in a benchmark window."""
    n_hit, n_words = F.col("n_hit") if n_hit is None else n_hit, F.col("n_words") if n_words is None else n_words
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str,
                  remove: str = "documents", **options) -> DataFrame:
    """``df`` without its contaminated documents (``remove="documents"``), or with every hit
    span cut out of the texts (``"spans"``).

    A null or empty text has no words and stays as it is; very long texts are scanned whole;
    repeated rows are judged alike; without items, or with an empty table, nothing changes.
    Items without an id count as the item of the empty id."""
    keep = {f"c{i}": c for i, c in enumerate(df.columns)}
    if remove == "documents":
        return _without_contaminated(df, text_col, items, item_id, item_text, **options)
    found = scan(df, text_col, items, item_id, item_text, keep, cleaned=True, **options)
    return found.select(*[(F.col("text") if c == text_col else F.col(n)).alias(c) for n, c in keep.items()])


def _without_contaminated(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str, **options) -> DataFrame:
    """Only the text goes to Python and only counts come back; rows stay with Spark.  Runs of
    hit words are carried from block to block, so words are counted once."""
    spark = df.sparkSession
    ready(spark)
    shape = "struct<n_words: int, n_hit: int, runs: array<int>>"
    runs = F.array().cast("array<int>")
    for index in blocks_of(items, item_id, item_text, **options):
        runs = F.arrow_udf(_counter(spark.sparkContext.broadcast(index)), shape)(F.col(text_col), runs)
        df = df.withColumn("_contamination", runs)
        runs = F.col("_contamination")["runs"]
    found = F.col("_contamination")
    return df.where(~contaminated(found["n_hit"], found["n_words"])).drop("_contamination")


def _counter(index):
    kind = pa.struct([("n_words", pa.int32()), ("n_hit", pa.int32()), ("runs", pa.list_(pa.int32()))])

    def counted(texts: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for text, runs in zip(utf8(texts), before.to_pylist()):
            words = words_of(text)
            mask, _ = index.value.hits(words)
            if mask is not None:
                for start, end in zip(runs[::2], runs[1::2]):
                    mask[start:end] = True
                runs = runs_of(mask)
            out.append({"n_words": len(words), "n_hit": sum(runs[1::2]) - sum(runs[::2]), "runs": runs})
        return pa.array(out, kind)

    return counted
