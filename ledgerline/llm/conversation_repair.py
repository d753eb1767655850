"""Repair of the role structure of conversations by a suffix-shared automaton.

Each row of a conversation becomes one sign: its role's initial and its fault.  A signature
is a word of such signs.  Cost-to-go depends on what follows only, so words are minimised
from the end: the distinct words of all conversations are sorted by their reversal, words
that end alike lie together, and each shared suffix is one node of the automaton, solved once
for the four states of the grammar ``(s?(ua)+)?`` (cost, cheapest edit, state after it).

Long conversations are cut into segments of at most ``SEGMENT`` rows.  Costs of a segment are
a 4 x 4 matrix (state before, state after); a pass over each conversation's segments from
its end multiplies these (min, +), so each segment knows the costs behind it, and a pass from
its start picks the edits.  Both passes hold four numbers, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.carry import AT, in_order
from ledgerline.llm.shared import join_skewed, ready, rows_of, write_through

#: Rows of one segment at most: a power of two, by its exponent.
SEGMENT_BITS = 8

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.  The role that may come next by an edit
#: (never the optional s), and the state after it.
NEXT = (2, 2, 3, 2)
NEXT_ROLE = ("user", "user", "assistant", "user")
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEVER = 1 << 40
#: Costs at the end of a conversation: what must still be inserted.
END = (0, 6, 3, 0)

_SPACE = r"\x20\x09-\x0D"


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text) of ``df`` with planted faults, by crc32 of ``conv_id:turn``
    mod 20: 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's.  Null roles, texts and parts of the
    key are one space."""
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(x, space) for x in (F.col(conv).cast("string"), F.lit(":"), F.col(turn).cast("string"))])
    kind = F.crc32(key.cast("binary")) % 20
    own = F.coalesce(F.col(text), space)
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                     F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
                     F.when(kind == 1, "").when(kind == 2, F.regexp_replace(own, "[.!?]", "")).otherwise(own).alias("text"),
                     kind.alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


def _signs(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, _at, fault, initial) of rows in order; fault: b, d, t or empty."""
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    placed = rows.select(
        "*", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"),
        F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("").alias("fault"))
    placed = in_order(placed, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"),
                      keep=["conv_id", "turn", "h1", "h2", "initial", "fault"])
    firsts = placed.groupBy("conv_id", "h1", "h2").agg(F.min(AT).alias(AT)).select(AT, F.lit(True).alias("first"))
    marked = placed.join(firsts, AT, "left")  # a row's place is unique, so no key is heavy
    return marked.select("conv_id", "turn", AT, "initial", F.when(
        (F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault")).alias("fault"))


def _segments(signs: DataFrame) -> DataFrame:
    """One row for each segment: its word and what its rows add to the counts."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(initial)).otherwise(initial)
    grouped = signs.groupBy("conv_id", F.shiftright(AT, SEGMENT_BITS).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct(AT, sign.alias("sign"), initial.alias("initial")))).alias("rows"),
        *[F.sum((F.col("fault") == k).cast("long")).alias(n) for k, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    return grouped.select("conv_id", "seg", F.array_join("rows.sign", "").alias("word"),
                          F.array_join("rows.initial", "").alias("initials"),
                          "blank", "duplicate", "truncated", "low", "high", "turns")


class Path:
    """The automaton's nodes on the way from the end to the start of the current word.

    Words come sorted by their reversal, so every suffix that words share is solved once."""

    def __init__(self, end: tuple[int, ...]):
        self.word, self.nodes = "", [(end, "", ())]

    def _node(self, sign: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
        """Costs, edits and next states of one more row in front; ties go to the least letter."""
        extra = TRUNCATED if sign.isupper() else 0
        best = []
        for state in range(4):
            found = [(after[state] + DELETE, "D", state)]
            if sign != "x":
                to = AFTER.get(sign.lower(), {}).get(state)
                if to is not None:
                    found.append((after[to] + KEEP + extra, "K", to))
                found.append((after[NEXT[state]] + REROLE + extra, "R", NEXT[state]))
            best.append(min(found))
        # inserts in front: two in a row lead back, so one step from u and a, then from the others
        u, a = best[2], best[3]
        best[2], best[3] = min(u, (a[0] + INSERT, "I", 3)), min(a, (u[0] + INSERT, "I", 2))
        for state in (0, 1):
            best[state] = min(best[state], (best[2][0] + INSERT, "I", 2))
        return tuple(min(c, NEVER) for c, _, _ in best), tuple(e for _, e, _ in best), tuple(t for _, _, t in best)

    def move(self, word: str) -> None:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[-1 - shared] == self.word[-1 - shared]:
            shared += 1
        del self.nodes[shared + 1:]
        for sign in reversed(word[:len(word) - shared]):
            self.nodes.append(self._node(sign, self.nodes[-1][0]))
        self.word = word

    def audit(self, state: int) -> tuple[str, int]:
        """The edits from ``state`` to the end of the word, and the state there."""
        out, at = [], len(self.nodes) - 1
        while at:
            _, edits, to = self.nodes[at]
            out.append(edits[state])
            at -= edits[state] != "I"
            state = to[state]
        return "".join(out), state


_SOLVED = pa.schema([("word", pa.string()), ("end", pa.string()), ("costs", pa.list_(pa.int64())),
                     ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])


def solved(words: DataFrame) -> DataFrame:
    """For distinct (word, end): costs, edits and last state from each of the four states.
    ``end``: the four costs behind the word, comma-joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, path = None, None
        for names, ends in rows_of(batches, "word", "end"):
            rows = []
            for word, end in zip(names, ends):
                if end != known:
                    known, path = end, Path(tuple(map(int, end.split(","))))
                path.move(word)
                each = [path.audit(s) for s in range(4)]
                rows.append({"word": word, "end": end, "costs": path.nodes[-1][0], "audits": [a for a, _ in each],
                             "exits": [s for _, s in each]})
            yield pa.RecordBatch.from_pylist(rows, _SOLVED)

    order = ["end", F.reverse("word"), "word"]
    return words.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "word string, end string, costs array<long>, audits array<string>, exits array<int>")


def _ends(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, end): the costs behind each segment of a conversation of several,
    less the smallest of them."""
    starts = [",".join(str(0 if t == s else NEVER) for s in range(4)) for t in range(4)]
    words = segments.select("word").distinct().select("word", F.explode(F.array(*map(F.lit, starts))).alias("end"))
    matrix = solved(words).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "costs"))).alias("m"))
    # ends sort as text: the one that begins with 0 first
    order = [sorted(starts).index(x) for x in starts]
    matrix = write_through(matrix.select("word", F.array(*[F.col("m")[i]["costs"] for i in order]).alias("m")), "repair-matrix")
    joined = join_skewed(segments.select("conv_id", "seg", "word"), matrix, ["word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, behind = object(), list(END)
        for convs, segs, matrices in rows_of(batches, "conv_id", "seg", "m"):
            ends = []
            for c, m in zip(convs, matrices):
                if c != conv:
                    conv, behind = c, list(END)
                least = min(behind)
                behind = [b - least for b in behind]
                ends.append(",".join(map(str, behind)))
                behind = [min(m[t][s] + behind[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(convs, pa.int64()), "seg": pa.array(segs, pa.int64()),
                                              "end": pa.array(ends, pa.string())})

    return joined.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc()).select(
        "conv_id", "seg", "m").mapInArrow(run, "conv_id long, seg long, end string")


_COUNTS = ("blank", "duplicate", "truncated")
_FOUND = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", *_COUNTS, "illegal", "cost")],
                    ("audit", pa.string())])
LEGAL = ("su", "ua", "au")


class _Conversation:
    """What the segments of one conversation, in order, add up to."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost, self.audits = conv_id, 0, 0, []
        self.counts, self.illegal, self.last = [0, 0, 0], 0, ""
        self.low = self.high = None
        self.turns = 0

    def add(self, initials: str, counts: tuple[int, ...], low, high, turns: int, end: str, costs, audits, exits) -> None:
        pairs = self.last + initials
        self.illegal += sum(pairs[i:i + 2] not in LEGAL for i in range(len(pairs) - 1))
        self.last = initials[-1]
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        behind, state = list(map(int, end.split(","))), exits[self.state]
        self.cost += costs[self.state] - behind[state]
        self.audits.append(audits[self.state])
        self.state = state

    def row(self) -> dict:
        trailing = END[self.state]
        return {"conv_id": self.conv_id, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
                **dict(zip(_COUNTS, self.counts)), "illegal": self.illegal, "cost": self.cost + trailing,
                "audit": "".join(self.audits) + "I" * (trailing // INSERT)}


def _along(segments: DataFrame) -> DataFrame:
    """One row for each conversation from its solved segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        names = ("conv_id", "initials", *_COUNTS, "low", "high", "turns", "end", "costs", "audits", "exits")
        for columns in rows_of(batches, *names):
            done = []
            for c, initials, b, d, t, *rest in zip(*columns):
                if now is None or c != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(c)
                now.add(initials, (b, d, t), *rest)
            yield pa.RecordBatch.from_pylist(done, _FOUND)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], _FOUND)

    counts = ", ".join(f"{n} long" for n in ("gaps", *_COUNTS, "illegal", "cost"))
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        run, f"conv_id long, {counts}, audit string")


def repaired_rows(role_texts: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The rows after the edits."""
    rows, state = iter(role_texts), 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[role[0]][state]
        else:
            role, state = NEXT_ROLE[state], NEXT[state]
        yield role, text


def _digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256).  A conversation's rows stream through one hash, so the
    task holds one row of text and the conversation's edits, a letter a row."""
    marks = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), F.col("audit").alias("text"))
    both = marks.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str]]:
        for columns in rows_of(batches, "conv_id", "kind", "role", "text"):
            yield from zip(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = pairs(batches)
        head = next(stream, None)
        while head is not None:
            conv, following = head[0], []

            def own() -> Iterator[tuple[str, str]]:
                for row in stream:
                    if row[1] == 0:
                        following.append(row)
                        return
                    yield row[2], row[3]

            rest, digest, first = own(), hashlib.sha256(), True
            for role, text in repaired_rows(rest, head[3]):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            for _ in rest:  # up to the next conversation
                pass
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()),
                                              "repaired_sha256": pa.array([digest.hexdigest()])})
            head = following[0] if following else None

    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    each conversation of ``rows`` (conv_id, turn, role, text; a null role or text is one space).

    Rows are taken by turn, null turns first, rows of one turn by role and text.  Rows without
    a conv_id are one conversation.  Very long texts are handled a row at a time, repeated rows
    are duplicates; an empty table gives no rows; other columns take no part."""
    ready(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                       *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    segments = write_through(_segments(_signs(rows)), "repair-segments")
    several = segments.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_several"))
    of_several = segments.join(several, F.col("conv_id").eqNullSafe(F.col("_several")), "left_semi")
    ends = _ends(of_several).select(F.col("conv_id").alias("_conv"), F.col("seg").alias("_seg"), "end")
    asked = segments.join(ends, (F.col("seg") == F.col("_seg")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    asked = write_through(asked.withColumn("end", F.coalesce("end", F.lit(",".join(map(str, END))))).drop("_conv", "_seg"),
                          "repair-asked")
    answers = write_through(solved(asked.select("word", "end").distinct()), "repair-words")
    found = write_through(_along(join_skewed(asked, answers, ["word", "end"])), "repair-found")
    digests = _digests(rows, found).withColumnRenamed("conv_id", "_conv")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def with_all(convs: DataFrame, conv: str, repaired: DataFrame) -> DataFrame:
    """``repaired`` and a row of zeros, an empty audit and the hash of nothing for each
    conversation of ``convs`` that it lacks."""
    ids: Column = F.col(conv).cast("long").alias("_all")
    joined = convs.select(ids).distinct().join(repaired, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select(F.col("_all").alias("conv_id"), *[
        F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in repaired.columns if c != "conv_id"])
