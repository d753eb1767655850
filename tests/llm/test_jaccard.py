import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import components as G
from ledgerline.llm import jaccard_join as J
from ledgerline.llm.partenum import Scheme, shingles


def plain(rows, width, percent):
    """Sizes, classes and link counts by comparing all pairs."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    count = {i: sum(i in x for x in links) for i in sets}
    return {i: (len(sets[i]), top(i), count[i]) for i in sets}


def group(rnd, n, size, changes):
    base = [f"w{rnd.randrange(400)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, changes)):
            words[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
        yield " ".join(words)


def result(df, width=4, percent=85):
    return {r.id: (r.n_shingles, r.component_id, r.n_links) for r in J.near_classes(df, "doc_id", "text", width, percent).collect()}


@pytest.mark.parametrize("most,block", [(32, 256), (3, 4)])  # the second: large buckets and many blocks
def test_classes_equal_all_pairs(docs_of, odd_texts, monkeypatch, most, block):
    monkeypatch.setattr(J, "MOST", most)
    monkeypatch.setattr(J, "BLOCK", block)
    rnd = random.Random(5)
    texts = [t for size, n, c in ((8, 6, 1), (30, 12, 2), (120, 25, 6), (400, 8, 25)) for t in group(rnd, n, size, c)]
    texts += ["One two THREE four five", "one  two three\nfour five", "a b", "A  b", "solo"] * 2
    rows = [*odd_texts, *((100 + i, t) for i, t in enumerate(texts))]
    assert result(docs_of(rows)) == plain(rows, 4, 85)


def test_null_ids_repeated_rows_and_empty_table(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    out = J.near_classes(docs_of(rows), "doc_id", "text", 4, 85).collect()
    assert sorted((r.id or 0, r.n_shingles, r.component_id) for r in out if r.id) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert [(r.n_shingles, r.component_id) for r in out if r.id is None] == [(None, None)]
    assert J.near_classes(docs_of(rows).where("false"), "doc_id", "text", 4, 85).count() == 0
    kept = J.one_of_each(docs_of(rows), "doc_id", "text")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]


def test_an_id_with_several_texts_joins_their_classes(docs_of):
    rows = [(5, "a b c d e f g"), (3, "p q r s t u v"), (5, "p q r s t u v"), (9, "a b c d e f g"), (11, "solo text here")]
    out = J.near_classes(docs_of(rows), "doc_id", "text", 4, 85).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in out) == [(3, 4, 3), (5, 4, 3), (5, 4, 3), (9, 4, 3), (11, 1, 11)]


def test_one_of_each_decides_by_texts(docs_of):
    alone, shared = "only this id has such a text", "p q r s t u v w x"
    unnamed = [(None, shared)] * 3 + [(None, "no id here")] * 2 + [(None, None)] * 2
    rows = [(5, alone), (5, shared), (5, shared + " y"), (3, shared), (3, shared), (9, alone), (11, "solo"), (12, ""), *unnamed]
    kept = J.one_of_each(docs_of(rows), "doc_id", "text")
    assert kept.columns == docs_of(rows).columns
    key = lambda r: (r[0] or 0, r[1] or "")
    want = [(None, None), (None, "no id here"), (None, shared), (3, shared), (3, shared), (5, alone), (11, "solo"), (12, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    kept = J.one_of_each(docs_of([(1, shared), (2, shared), *unnamed]), "doc_id", "text")  # ids of one row each
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([*want[:3], (1, shared)], key=key)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("exact", [False, True])
def test_similar_sets_share_a_signature(percent, exact):
    rng = np.random.default_rng(11)
    scheme = Scheme(percent, exact=exact)
    for size in [1, 2, 3, 5, 7, 8, 11, 13, 20, 37, 60, 99, 150, 300, 700, 2000] * 12:
        most = size * (100 - percent) // 100
        gone = int(rng.integers(0, most + 1))
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        other = base[gone:]
        # new features up to the threshold
        shared = len(other)
        extra = max(0, 100 * shared // percent - len(base))
        other = np.unique(np.concatenate([other, rng.integers(0, 2**63, extra, dtype=np.int64).astype(np.uint64)]))
        assert 100 * shared >= percent * (len(base) + len(other) - shared)
        (a, need_a, unsafe_a), (b, need_b, unsafe_b) = scheme.signatures(base), scheme.signatures(other)
        if unsafe_a and unsafe_b:
            continue  # both go to the second round
        band = scheme.band(max(len(base), len(other)))
        both = {int(s) for s in np.intersect1d(a, b)}
        parts = {s & 0x1FFF for s in both if (s >> 13) & 0x7F == band % 128}
        need = max(int(n) for sig, needs in ((a, need_a), (b, need_b)) for s, n in zip(sig, needs) if int(s) in both)
        assert len(parts) >= need >= 1


def test_shingles():
    assert len(shingles(b"", 4)) == len(shingles(b" \n", 4)) == 0
    assert (shingles(b"A b\tC", 4) == shingles(b"a B c", 4)).all() and len(shingles(b"a b c", 4)) == 1
    assert len(shingles(b"a a a a a a", 4)) == 1 and len(shingles(b"a b c d e", 4)) == 2
    assert shingles(b"a b c", 4)[0] not in shingles(b"a b c d", 4)
    assert shingles(" a b".encode(), 4)[0] != shingles(b"a b", 4)[0]  # only ASCII white space ends words


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [
        (rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert got == {i: top(i) for i in root if i != 7}


def test_signature_batches_are_bounded_whatever_a_batch_of_documents_gives(monkeypatch):
    monkeypatch.setattr(J, "SIGNED_ROWS", 1000)
    sets = [np.arange(k * 10_000, k * 10_000 + n).astype(np.int64) for k, n in enumerate([200] * 20 + [0, 400])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sets))), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], names=["id", "features"])
    scheme = Scheme(80, 1, True)

    class Rows:  # what a task is given
        columns = batch.schema.names

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([batch.slice(1), batch.slice(0, 1)])))

    found = J.signed(Rows(), scheme, 5)
    one = len(scheme.signatures(sets[-1].view(np.uint64))[0])
    assert len(found) > 5 and max(b.num_rows for b in found) < 1000 + one
    own = {d: [] for d in range(len(sets))}
    for b in found:
        for sig, doc, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            assert n == len(sets[doc])
            own[doc].append(sig)
    for d, x in enumerate(sets):
        assert own[d] == (scheme.signatures(x.view(np.uint64))[0].view(np.int64).tolist() if len(x) else [])
