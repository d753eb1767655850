"""SimHash: fingerprints bit by bit, links and classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import queries as Q
from ledgerline.llm import simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Classes of (id, fingerprint) rows by comparing all."""
    p = np.array([f for _, f in prints], np.uint64)
    label = list(range(len(p)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1:] ^ p[i]) <= 3) + i + 1:
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, f"{f:016x}", least.get(top(i))) for i, (doc, f) in enumerate(prints)]


def key(rows):
    return sorted(rows, key=repr)


def test_query_equals_a_comparison_of_all(spark, sf, sample):
    got = [tuple(r) for r in Q.QUERIES["op11_simhash_dedup"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()]
    assert key(got) == key(plain_classes([(d, plain_print(t)) for d, t in sample]))


def test_odd_texts(spark, docs_of, odd_texts):
    rows = [*odd_texts, (7, "tie tie tie tie tie"), (None, "one two three"), (None, "alone alone"), (11, "One\tTWO three ")]
    got = [tuple(r) for r in simhash.near_documents(docs_of(rows), "doc_id", "text").collect()]
    assert key(got) == key(plain_classes([(d, plain_print(t)) for d, t in rows]))
    assert simhash.near_documents(docs_of([]), "doc_id", "text").collect() == []


def near_prints(seed, n):
    """Clusters of prints that differ in a few of some weak bits, and prints of their own."""
    r = random.Random(seed)
    out = {0, 1, 2**64 - 1, 2**63}
    while len(out) < n:
        centre, weak = r.getrandbits(64), r.sample(range(64), 14)
        for _ in range(r.choice([1, 1, 1, 2, 5, 400])):
            x = centre
            for b in r.sample(weak, r.randrange(8)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf", [4096, 64])
def test_links_join_all_within_three_bits(spark, monkeypatch, leaf):
    """Also when large nodes are split several times."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    prints = near_prints(leaf, 1500)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in links)
    label = {x: x for x in signed}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    want = plain_classes([(i, p) for i, p in enumerate(prints)])
    place = {x: i for i, x in enumerate(signed)}
    got = {}
    for x in signed:
        got.setdefault(top(x), []).append(place[x])
    classes = {}
    for i, _, c in want:
        classes.setdefault(c, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(classes.values())


def test_index_of_one_dense_node():
    """All prints of 11 weak bits: everything is joined, by a forest and not by all pairs."""
    prints = np.arange(1 << 11, dtype=np.uint64) << np.uint64(7)
    i, j = simhash.GrayIndex(np.zeros(len(prints), np.int64), prints).forest(3)
    assert len(i) == len(prints) - 1


def test_gray_rank_inverts_the_code():
    x = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()
