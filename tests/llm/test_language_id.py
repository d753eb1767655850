from ledgerline.llm import language_id as L

EN = "the weather and the other things that they think about with their brothers"
DE = "der Schnee und die Straße über das schöne Haus mit einer großen Küche"


def rows(n=40):
    out = []
    for i in range(n):
        out.append((2 * i, " ".join(EN.split()[i % 5:]) + f" {i}", "en"))
        out.append((2 * i + 1, " ".join(DE.split()[i % 5:]) + f" {i}", "de"))
    return out


def test_learns_and_judges_odd_rows(docs_of, odd_texts):
    model = L.train(docs_of([*rows(), (None, EN, None), (900, None, "en"), (901, "12", "de")]), "doc_id", "text", "lang")
    assert model.languages == ["de", "en"]
    df = docs_of([*odd_texts, (100, "with their other weather"), (101, "über die große Straße"), (101, "über die große Straße")])
    out = L.identify(
        df, "text", model, {"doc_id": "doc_id"})
    got = out.collect()
    assert len(got) == len(odd_texts) + 3 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert {by[i] for i in (1, 2, 3, 4)} == {L.UNDETERMINED} and by[100] == "en" and by[101] == "de"
    assert out.where("false").count() == 0
    kept = L.keep_identified(df, "text", model)
    assert kept.columns == df.columns and {1, 2, 3, 4}.isdisjoint({r.doc_id for r in kept.collect()})


def test_without_labelled_rows_everything_is_undetermined(docs_of):
    model = L.train(docs_of([(1, EN, None)]), "doc_id", "text", "lang")
    assert [r.lang_pred for r in L.identify(docs_of([(1, EN)]), "text", model, {"doc_id": "doc_id"}).collect()] == ["und"]


def test_kernel_is_the_share_of_common_ngrams():
    kernel = L.Kernel(max_n=2, dims=1 << 16)

    def grams(t):
        t = f" {t} "
        return {t[i:i + n] for n in (1, 2) for i in range(len(t) - n + 1)}

    a, b = "abcab", "bcd"
    x = kernel.matrix(*(kernel.present(t)[None].astype("f4") for t in (a, b)))[0, 0]
    assert abs(x - len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5) < 1e-6


def test_long_texts_are_hashed_in_steps(monkeypatch):
    kernel, text = L.Kernel(), " ".join(f"w{i}" for i in range(3000))
    whole = kernel.present(text)
    monkeypatch.setattr(L, "_STEP", 100)
    assert (kernel.present(text) == whole).all()


def test_scores_equal_a_direct_solve(docs_of):
    """The fitted weights against kernel ridge regression solved on sets of n-gram cells."""
    import numpy as np
    sample = rows(12)
    kernel = L.Kernel(dims=1 << 10)
    present = np.array([kernel.present(t) for _, t, _ in sample])
    labels, mark = [lang for *_, lang in sample], np.arange(len(sample)) % 3 == 0
    model = L.Classifier.fit(kernel, present, labels, mark, ridge=0.5)
    cells = [set(np.flatnonzero(p).tolist()) for p in present]

    def k(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    marks = [c for c, m in zip(cells, mark) if m]
    near = np.array([[k(a, b) for b in marks] for a in cells])
    own = np.array([[k(a, b) for b in marks] for a in marks])
    weight = np.diag([1 / labels.count(x) for x in labels])
    target = np.array([[1.0 if x == lang else -1.0 for lang in model.languages] for x in labels])
    alpha = np.linalg.solve(near.T @ weight @ near + 0.5 * own, near.T @ weight @ target)
    scores = np.exp(4 * near @ alpha)
    want = scores / scores.sum(1, keepdims=True)
    names, got = model.predict([t for _, t, _ in sample])
    assert names == [model.languages[i] for i in want.argmax(1)] and np.allclose(got, want.max(1), atol=1e-3)


def test_long_texts_of_no_learned_language_go(docs_of):
    long = [(i, " ".join([t] * 4), lang) for i, t, lang in rows()]
    model = L.train(docs_of(long), "doc_id", "text", "lang")
    odd = "これは日本語の文章です。天気がとても良いので、散歩に行きましょう。" * 10
    kept = L.keep_identified(docs_of([*long, (900, odd), (901, odd[:50]), (902, None)]), "text", model)
    assert model.floor > 0.25 and {r.doc_id for r in kept.collect()} == {i for i, *_ in long} | {901}
