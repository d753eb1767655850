"""The pipeline's stages against plain versions, on the smallest documents."""

import corpus_pipeline as P
from ledgerline.llm import decontaminate, language_id
from tests.llm.test_jaccard import plain as classes
from tests.llm.test_secrets import plain as secrets_of


def test_stages(spark, sf, con, sample):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(sample)
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        out = P.write_through(stage(spark, docs, sf), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if stage is P.identify_language:
            assert after.keys() == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif stage is P.drop_near_copies:
            found = classes(sorted(before.items()), 5, 80)
            assert after.keys() == {i for i in before if found[i][1] == i}
        elif stage is P.drop_contaminated:
            items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
            index = decontaminate.WindowIndex([(str(i), t.encode()) for i, t in items])
            dropped = set()
            for i, t in before.items():
                words = decontaminate.words_of(t.encode())
                mask, _ = index.hits(words)
                if mask is not None and 20 * int(mask.sum()) >= len(words):
                    dropped.add(i)
            assert after.keys() == before.keys() - dropped
        elif stage is P.mask_secrets:
            assert after.keys() == before.keys()
            for i, r in after.items():
                if not secrets_of(r.text) and "[secret]" not in r.text:
                    assert r.text == before[i] and not secrets_of(before[i])
                assert not secrets_of(r.text) and r.n_chars == len(r.text)
        else:
            assert after.keys() == before.keys() and all(r.round_trip for r in after.values())
        if stage is not P.encode:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(after)
    assert texts and language_id.UNDETERMINED == "und"


def test_stages_with_odd_rows(spark, sf, docs_of, odd_texts):
    """Null, empty, blank and very long texts, repeated rows, null ids, extra columns; and no rows."""
    long = " ".join(f"alone{i}" for i in range(300))
    rows = [*odd_texts, (20, long), (21, long), (20, long), (None, long), (None, long), (22, f"{long} token=abcdefghijkl1234 end")]
    docs = docs_of(rows)
    kept = {}
    for name, stage in P.STAGES:
        out = P.write_through(stage(spark, docs, sf), "test")
        assert stage(spark, docs.where("false"), sf).count() == 0
        if stage is not P.encode:
            assert out.columns == docs.columns
        docs = out
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    first, near = kept["language ID"], kept["n-gram Jaccard join"]
    assert [i for none, i in first if not none] == [5, 6, 7, 8, 9, 10, 20, 20, 21, 22] and first.count((True, 0)) == 2
    assert near == [(False, i) for i in (5, 6, 7, 9, 10, 20, 20)] + [(True, 0)]
    assert kept["SentencePiece encoding"] == kept["secret scans"] == kept["benchmark decontamination"] == near
