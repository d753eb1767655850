from ledgerline.llm import decontaminate as D

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
         (2, "short item"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen")]


def plain(text, items=ITEMS, width=13):
    """Hit words and items by comparing every window."""
    words = [w.decode() for w in D.words_of((text or "").encode())]
    hit, found = set(), set()
    for item, content in items:
        own = [w.decode() for w in D.words_of((content or "").encode())]
        n = min(width, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


PASSAGE = ITEMS[0][1]
TEXTS = [PASSAGE, PASSAGE.upper().replace(" ", ", "), "x " + PASSAGE[:-8] + " y", PASSAGE.replace("eta theta", "eta, theta"),
         "alpha beta gamma", "a short item here, SHORT--ITEM", "é short itemé", None, "", "...", "lorem " * 30_000 + PASSAGE,
         " ".join([PASSAGE, ITEMS[4][1], PASSAGE]), "short item", "short item"]


def test_hits_equal_a_plain_version(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (D.BLOCK_BYTES, 120):  # one block, and one for almost every item
        rows = D.scan(docs_of(list(enumerate(TEXTS))), "text", items, "item_id", "text", {"doc_id": "doc_id"},
                      block_bytes=block).collect()
        assert len(rows) == len(TEXTS)
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_documents_or_spans_are_removed(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([(1, f"Before. {PASSAGE}, after é."), (2, "clean text"), (3, None), (4, "lorem " * 400 + PASSAGE)])
    kept = D.decontaminate(df, "text", items, "item_id", "text")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]  # 15 of 415 words
    cut = {r.doc_id: r.text for r in D.decontaminate(df, "text", items, "item_id", "text", remove="spans").collect()}
    assert cut == {1: "Before. , after é.", 2: "clean text", 3: None, 4: "lorem " * 400}


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([(1, PASSAGE)])
    assert D.scan(df.where("false"), "text", items, "item_id", "text", {"doc_id": "doc_id"}).count() == 0
    (row,) = D.scan(df, "text", items.where("false"), "item_id", "text", {"doc_id": "doc_id"}).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (15, 0, [])
