"""Conversation repair and the prefix trie: odd tables against the SQL, long conversations
that span segments and tasks, empty tables, repeated rows, ties."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from ledgerline.llm import conversation_queries as Q
from ledgerline.llm import conversation_repair as R
from ledgerline.llm import prefix_trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       # names that the operators use inside
                       *[T.StructField(n, T.StringType()) for n in ("kind", "seg", "word", "depth", "_at", "place")]])


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small tables keep their tasks, so conversations and keys cross borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tables(spark, rows):
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)
    con = duckdb.connect()
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    conversations = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text"])
    con.register("conversations", conversations)
    return df, con


def repaired(df):
    return R.with_all(df, "conv_id", R.repair(R.damage(df, "conv_id", "turn", "role", "text")))


def trie(df):
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(df, "conv_id", "turn", "role", "text")))


def equal(df, con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, res.fetchall()))


def odd_rows(seed, convs, turns):
    r = random.Random(seed)
    texts = ["Yes.", "no", "", "  \n", "What?", "Well!  ", None, "a.b", "é漢.", "x" * 70_000 + "."]
    rows = []
    for c in range(convs):
        for t in range(r.randrange(turns)):
            row = (c, t + (r.random() < 0.1) * 2, r.choice(["user", "assistant", "system", "tool", "", None]
                                                          if r.random() < 0.4 else ["user", "assistant"]), r.choice(texts))
            rows += [row] * (2 if r.random() < 0.05 else 1)
    rows += [(1000, None, "user", "Q."), (1000, None, "assistant", "A."), (1000, 3, "user", "More?"),
             (1001, 2, "user", "b."), (1001, 2, "assistant", "a."), (-7, 0, "user", "Minus."), (2**62, 0, "system", "Far.")]
    return rows


@pytest.mark.parametrize("bits", [8, 1])
def test_repair_of_odd_rows_equals_its_sql(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "SEGMENT_BITS", bits)
    df, con = tables(spark, odd_rows(1, 60, 12))
    equal(repaired(df), con, Q.REPAIR_SQL)


def test_a_conversation_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT_BITS", 4)
    r = random.Random(5)
    rows = [(3, t, r.choice(["user", "assistant", "system"]), r.choice(["A.", "b", "", f"c{t}?"])) for t in range(400)]
    df, con = tables(spark, rows + odd_rows(2, 5, 4))
    equal(repaired(df), con, Q.REPAIR_SQL)


def test_rows_without_a_conversation_are_one(spark):
    rows = [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, 2, "assistant", "Hi.")]
    df, _ = tables(spark, rows)
    (row,) = R.repair(df).collect()
    assert (row.conv_id, row.duplicate, row.audit, row.cost) == (None, 1, "KKD", 4)


def test_empty_tables(spark):
    df, _ = tables(spark, [])
    assert repaired(df).collect() == [] and trie(df).collect() == []


def test_ties_take_the_least_letters(spark):
    # delete the first (4) or re-role (3): re-role; u u: insert (3) or re-role (3): the insert first
    df, _ = tables(spark, [(1, 0, "user", "A."), (1, 1, "user", "B."), (2, 0, "assistant", "C.")])
    assert {r.conv_id: (r.audit, r.cost) for r in R.repair(df).collect()} == {1: ("KR", 3), 2: ("IK", 3)}


def test_a_node_is_solved_once_for_each_shared_suffix():
    words = sorted(["uaua", "suaua", "xua", "ua", "uaUa"], key=lambda w: w[::-1])
    path, solved = R.Path(R.END), []
    inner = path._node
    path._node = lambda sign, after: solved.append(sign) or inner(sign, after)
    for w in words:
        path.move(w)
    assert len(solved) == len({w[i:] for w in words for i in range(len(w))})


def test_trie_of_odd_rows_equals_its_sql(spark):
    rows = odd_rows(3, 40, 6)
    rows += [(c, t, "user", f"same {t}.") for c in range(2000, 2030) for t in range(4)]  # copies, and prefixes of them
    rows += [(c, t, "user", f"same {t}.") for c in range(2030, 2040) for t in range(6)]
    df, con = tables(spark, rows)
    equal(trie(df), con, Q.TRIE_SQL)


def test_trie_of_one_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(300)] + [(6, 0, "user", "turn 0"), (7, 0, "user", "other")]
    df, con = tables(spark, rows)
    equal(trie(df), con, Q.TRIE_SQL)


def test_end_lists_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(c * 5, 0, "user", "same") for c in range(300)]
    df, con = tables(spark, rows)
    equal(trie(df), con, Q.TRIE_SQL)
