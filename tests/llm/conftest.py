import os

import duckdb
import pytest
from pyspark.sql import types as T

SF = os.environ.get("LEDGERLINE_TEST_SF", "/root/testdata/sf0.001")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use inside
                     T.StructField("id", T.StringType()), T.StructField("w", T.StringType()),
                     T.StructField("key", T.StringType()), T.StructField("n_words", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 len(r[1] or ""), "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, no letters, short, a very long text, repeated rows, signs."""
    long = " ".join(f"word{i % 5000} lorem" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t"), (4, "123 !!"), (5, "a"), (6, long), (7, "tie tie tie tie tie"),
            (8, "tie tie tie tie tie"), (9, "é漢 \U0001F600 ﬁ ẞ İ"), (10, "one two three")]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def sample(con):
    """The documents of the smallest tables as (doc_id, text)."""
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
