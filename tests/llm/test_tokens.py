import random

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import sentencepiece_codec as S
from ledgerline.llm import token_counts as C
from ledgerline.llm import token_files as T
from ledgerline.llm.queries import tokenizer_file


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(gaps)
    ef = T.EliasFano.of(values)
    assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_elias_fano_is_near_minimal():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 20, 10_000))
    ef = T.EliasFano.of(values)
    assert 8 * (len(ef.low) + len(ef.high)) <= 10_000 * (2 + 7) + 64  # 2 + log2(u / n) bits each


def test_file_image_round_trip():
    docs = [np.array(x, "<u2").tobytes() for x in ([1, 2, 3], [], [65535] * 1000, [7])]
    bounds, ids = T.unpack(T.pack(docs, 2))
    ends = bounds.values()
    assert [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] == docs


SIGNS = list("abKÀéßſİıJjẖΣσς漢̌̇́ .,!'sSt<|endoftext|>  \t\n\x0b\x1c\x850½²١_*\U0001F600ﬁÅÅK")


def test_chunks_give_the_ids_of_whole_texts():
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    tokenizer, encoder, rnd = Tokenizer.from_str(spec), T._Encoder(spec, 2), random.Random(7)
    assert T.drops_white_space(spec) and T.splits_words(spec)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> they'Ve it's", "Éreaux, ÉREAUX; éreaux..,"]
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def split(some):
        ids, lengths = encoder.ids(pa.array(some, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]

    assert split(texts) == want
    assert [x for i in range(0, len(texts), 7) for x in split(texts[i:i + 7])] == want
    assert split(pa.array(["cut off", *texts]).slice(1).to_pylist()) == want
    encoder.table.most = 100  # full tables are emptied, answers stay
    assert [split([t])[0] for t in texts] == want


def test_texts_without_spaces_are_not_kept():
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = T._Encoder(f.read(), 2)
    long = ["".join(random.Random(i).choices("abcdef0123456789+/", k=20_000)) for i in range(40)]
    want = [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in long]
    assert encoder.ids(pa.array(long))[1].tolist() == want
    assert not encoder.table.slots and encoder.ids(pa.array(["a a b"]))[0].tolist()[-1] == 2 and len(encoder.table.slots) == 2
    encoder.table.most = 10_000
    for i in range(50):
        encoder.ids(pa.array([f"word{i} other{i}"]))
        assert encoder.table.held < 20_000


def test_token_files_of_odd_rows(spark, docs_of, odd_texts, tmp_path):
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = [*odd_texts, (None, "no id"), (7, "tie tie tie tie tie")]
    path = str(tmp_path / "files")
    T.write_token_files(docs_of(rows), "doc_id", "text", tokenizer_file("word_bpe_49k.json"), 2, path, segment_ids=50)
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    at = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        assert r.start == at and r.ids == [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        at += r.n_tokens
    empty = str(tmp_path / "none")
    T.write_token_files(docs_of(rows).where("false"), "doc_id", "text", tokenizer_file("word_bpe_49k.json"), 2, empty)
    assert T.read_token_files(spark, empty).count() == 0


@settings(max_examples=300)
@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=8), st.sets(st.text("abc", min_size=1, max_size=5), max_size=8),
       st.text("abc", min_size=1, max_size=14))
def test_automaton_equals_greedy(first, later, word):
    first, later = {x.encode() for x in first}, {x.encode() for x in later}

    def greedy(w):
        at = n = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (later if at else first)), 0)
            if not end:
                return 0
            at, n = end, n + 1
        return n

    assert C.Automaton(first, later).count(word.encode()) == greedy(word.encode())


def test_counts_of_odd_rows(docs_of, odd_texts):
    rows = C.count_tokens(docs_of(odd_texts), "text", tokenizer_file("byte_bpe_50k.json"), {"n_words": "doc_id"}).toPandas()
    assert len(rows) == len(odd_texts)
    df = C.count_tokens(docs_of(odd_texts), "text", tokenizer_file("byte_bpe_50k.json"), {"doc_id": "doc_id"})
    got = {r.doc_id: (r.n_tokens, r.n_words) for r in df.collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[7] == got[8] and got[6][1] == 120_000
    assert df.where("false").count() == 0


def test_pieces_of_odd_rows(spark, docs_of, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = [*odd_texts, (20, " lead"), (21, "trail  "), (22, "a▁b ▁"), (23, "<s> </s> <0x41> <unk>"), (24, " "), (25, "\n\n x\ty")]
    df = docs_of(rows)
    out = S.encode_pieces(df, "text", tokenizer_file("piece_bpe_32k.model"), {"doc_id": "doc_id"})
    for r in out.collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == library.encode(text, num_threads=1) and r.round_trip and r.parity
    back = S.decode_pieces(out, "ids", tokenizer_file("piece_bpe_32k.model"), {"doc_id": "doc_id"})
    assert {r.doc_id: r.text for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert S.encode_pieces(df.where("false"), "text", tokenizer_file("piece_bpe_32k.model"), {"doc_id": "doc_id"}).count() == 0


def test_model_file_is_read_as_the_library_reads_it():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    model, library = S.Model.parse(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [p[0] for p in model.pieces] == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert [p[1] for p in model.pieces] == [library.get_score(i) for i in range(library.get_piece_size())]
    assert model.kind == S.BPE and model.byte_fallback and model.add_dummy_prefix and not model.remove_extra_whitespaces


class _Agreeing(list):
    """Ids that equal any others."""

    def __eq__(self, other):
        return True

    def __ne__(self, other):
        return False


def test_ids_are_the_backends_unless_the_library_differs(monkeypatch):
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    texts, mine = [b"one two", b" x  y", "漢 é".encode()], S.Codec(data)
    want = mine.encode(texts)
    monkeypatch.setattr(S.Codec, "_verified", lambda self, chunks: [_Agreeing([7])] * len(chunks))
    assert S.Codec(data).encode(texts) == want and all(parity for _, parity, _ in want)
    monkeypatch.setattr(S.Codec, "_verified", lambda self, chunks: [[7]] * len(chunks))
    codec = S.Codec(data)
    for text, (ids, parity, _) in zip(texts, codec.encode(texts)):
        assert ids == np.array([7] * len(codec.chunks(text)), "<u4").tobytes() and not parity
