"""Token counts by a linear longest-match automaton.

Greedy word-piece splits a word into the longest known piece from its start, then the
longest known continuing piece, and so on.  The automaton reads each byte once: a trie of
all pieces, where a node without a fitting child has a failure link to the node that the
greedy split would stand at after giving up the pieces matched so far, and the *number* of
those pieces, computed beforehand.  Adding the numbers gives the count; no piece is built.
A word that no split covers is one unknown token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.memo import Memo, kept
from ledgerline.llm.shared import ready, utf8

#: A word is a run of ASCII letters, digits and non-ASCII bytes, or one other visible byte.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]|[\x00-\x08\x0e-\x1f\x7f]")


#: Bits of one count in a packed sum.
FIELD = 48


class Automaton:
    """``first``: pieces that may start a word; ``later``: pieces that may continue one."""

    START, CONTINUE = 0, 1

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        ends: set[int] = set()
        parents: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((self.START, first), (self.CONTINUE, later)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.child.get(key, -1)
                    if node < 0:
                        node = self.child[key] = len(parents)
                        parents.append((key >> 8, byte))
                ends.add(node)
        # breadth first: links of shorter strings are known before those of longer ones
        depth = [0, 0]
        for parent, _ in parents[2:]:
            depth.append(depth[parent] + 1)
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        for node in sorted(range(2, len(parents)), key=depth.__getitem__):
            if node in ends:  # the node's string is a piece: give it up as one token
                self.fail[node], self.pops[node] = self.CONTINUE, 1
                continue
            parent, byte = parents[node]
            to, n = self.fail[parent], self.pops[parent]
            while to >= 0 and (to << 8 | byte) not in self.child:
                to, n = self.fail[to], n + self.pops[to]
            if to >= 0:
                self.fail[node], self.pops[node] = self.child[to << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of the greedy split; 0 if there is none."""
        child, fail, pops = self.child, self.fail, self.pops
        node, n = self.START, 0
        for byte in word:
            while (after := child.get(node << 8 | byte, -1)) < 0:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = after
        while node != self.CONTINUE:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def byte_level_pieces(spec: str) -> tuple[list[bytes], list[bytes]]:
    """First and later pieces of a byte-level vocabulary: those with a leading space start a
    word.  Its characters stand for bytes: visible Latin-1 for themselves, the other bytes,
    in order, for characters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}
    tokens = [bytes(byte[c] for c in t) for t in json.loads(spec)["model"]["vocab"] if all(c in byte for c in t)]
    first = [t[1:] for t in tokens if t[:1] == b" "]
    return first, [t for t in tokens if t[:1] != b" "]


class _Counter:
    def __init__(self, spec: str):
        self.automaton = Automaton(*byte_level_pieces(spec))
        self.memo = Memo(self._counted)

    def _counted(self, chunks: list[bytes]) -> Iterator[int]:
        """Tokens, words and unknown words of a chunk, as one number that can be added."""
        for chunk in chunks:
            each = [self.automaton.count(w) for w in WORD.findall(chunk)]
            yield sum(n or 1 for n in each) | len(each) << FIELD | each.count(0) << 2 * FIELD


def count_tokens(df: DataFrame, text_col: str, vocabulary_file: str, keep: dict[str, str]) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` (new name: column),
    ``n_tokens``, ``n_words`` and ``n_unknown``.

    Null and empty texts count 0; repeated rows are rows of their own; an empty table gives
    no rows; other columns take no part."""
    spark = df.sparkSession
    ready(spark)
    with open(vocabulary_file, encoding="utf-8") as f:  # on the driver; executors get the contents
        shipped = spark.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("counts", hash(shipped.value)), lambda: _Counter(shipped.value))
        for batch in batches:
            split = [t.split() for t in utf8(batch.column("text"))]
            counter.memo.learn(split)
            sums = [sum(map(counter.memo.__getitem__, chunks)) for chunks in split]
            found = [pa.array([s >> at & (1 << FIELD) - 1 for s in sums], pa.int64()) for at in (0, FIELD, 2 * FIELD)]
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *found],
                                             names=[*batch.schema.names[:-1], "n_tokens", "n_words", "n_unknown"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(counted, ", ".join([*fields, "n_tokens long, n_words long, n_unknown long"]))
    return out.select(*[F.col(f"k_{n}").alias(n) for n in keep], "n_tokens", "n_words", "n_unknown")
