"""Every query of the operators against its SQL, or against a plain version."""

import zlib

import numpy as np
import pytest

from ledgerline.llm import queries as Q
from ledgerline.llm import token_counts, url_filter


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(Q.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[i] for i in at)) for r in got) == sorted(map(repr, res.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_token_counts_equal_a_greedy_search(spark, sf, sample):
    with open(Q.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        first, later = map(set, token_counts.byte_level_pieces(f.read()))

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), 0)
            if not end:
                return 0
            at, n = end, n + 1
        return n

    want = {}
    for doc, text in sample:
        each = [greedy(w) for w in token_counts.WORD.findall(text.encode())]
        want[doc] = (sum(n or 1 for n in each), len(each), each.count(0))
    got = {r.doc_id: (r.n_tokens, r.n_words, r.n_unknown) for r in Q.op3_token_counts(spark, sf).collect()}
    assert got == want


def test_languages_of_held_out_rows(spark, sf, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = Q.op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_token_files_equal_whole_text_encoding(spark, sf, sample):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json"))
    want, start = [], 0
    for doc, text in sample:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in Q.op5_token_files(spark, sf).collect()) == want


def test_pieces_equal_the_library(spark, sf, sample):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))
    ids = library.encode([t for _, t in sample], num_threads=1)
    want = [(doc, len(i), zlib.crc32(np.array(i, "<u4").tobytes()), True) for (doc, _), i in zip(sample, ids)]
    got = sorted(Q.op6_sentencepiece(spark, sf).collect())
    assert [(r.doc_id, r.n_pieces, r.ids_crc32, r.round_trip) for r in got] == want


def test_pieces_of_the_backend_equal_the_library(spark, sf, sample):
    rows = Q.op6_sentencepiece(spark, sf).collect()
    assert len(rows) == len(sample) and all(r.parity for r in rows)


def test_url_rules_equal_a_plain_version(spark, sf, con):
    for r in Q.op8_url_filter(spark, sf).collect():
        (url,) = con.execute("SELECT url FROM pages WHERE page_id = ?", [r.page_id]).fetchone()
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest[:min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        path = rest[len(host):]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(h + p, v) for v, h, p in url_filter.RULES
                if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, r.method_verdict))
        assert (r.host, r.path, r.rule, r.verdict) == (host.lower(), path, rule, verdict)
