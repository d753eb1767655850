from pyspark.sql import functions as F

from ledgerline.llm import sharding, url_filter


def test_every_shard_fits_and_only_large_prefixes_split(docs_of):
    df = docs_of([(i, "x" * (i % 97)) for i in range(3000)])
    rows = sharding.assign_shards(df, "doc_id", F.octet_length("text"), 4000).collect()
    assert len(rows) == 3000
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        assert r.depth == len(r.shard)
    assert all(sums[r.shard] == r.shard_bytes <= 4000 and not r.oversized for r in rows)
    shards = list(sums)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)  # a prefix code
    for s in shards:  # the parent did not fit
        assert not s or sum(n for t, n in sums.items() if t.startswith(s[:-1])) > 4000


def test_hot_key_null_keys_and_oversized_rows(docs_of):
    df = docs_of([(7, "y" * 100)] * 400 + [(None, "z" * 50)] * 100 + [(1, None), (2, ""), (3, "q" * 9000)])
    rows = sharding.assign_shards(df, "doc_id", F.octet_length("text"), 1000).collect()
    assert len(rows) == 503
    assert all(r.shard_bytes <= 1000 or r.oversized for r in rows)
    assert [(r.key, r.shard_rows) for r in rows if r.oversized] == [(3, 1)]


def test_one_shard_and_empty_table(docs_of):
    df = docs_of([(1, "a"), (2, "b")])
    assert {r.shard for r in sharding.assign_shards(df, "doc_id", F.octet_length("text"), 100).collect()} == {""}
    assert sharding.assign_shards(df.where("false"), "doc_id", F.octet_length("text"), 100).count() == 0


def test_written_shards_hold_all_rows(spark, docs_of, tmp_path):
    df = docs_of([(i, "x" * 50) for i in range(200)])
    sharding.write_shards(df, "doc_id", F.octet_length("text"), 2000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 2000").count() == 0


def test_written_shards_of_a_hot_key_and_null_ids_fit(spark, docs_of, tmp_path):
    df = docs_of([(7, "y" * 50)] * 200 + [(None, "z" * 50)] * 200 + [(i, "x" * 50) for i in range(100, 300)])
    sharding.write_shards(df, "doc_id", F.octet_length("text"), 2000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    sums = {r.shard: r.n for r in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert max(sums.values()) <= 2000
    shards = [s[1:] for s in sums]
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)  # a prefix code
    assert all(back.where(c).select("shard").distinct().count() >= 5 for c in ("doc_id = 7", "doc_id is null"))


def test_url_parts_and_rules(spark):
    rows = [(1, None), (2, "no scheme/en/"), (3, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "x://example.com"),
            (5, "x://aexample.com/en/1"), (6, "x://example.com/en/1"), (7, "x://a.net/fr/"), (8, "x://?q"), (9, ""),
            (10, "x://com/"), (10, "x://com/"), (11, "x://a.org/https://b.net/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit(1))
    model = url_filter.train(url_filter.labelled_urls(spark))
    out = {r.id: r for r in url_filter.judge_urls(df, "page_id", "url", model).collect()}
    assert [(out[i].host, out[i].path) for i in (1, 2, 3, 4, 8, 11)] == [
        ("", ""), ("", ""), ("www.example.com", "/en/x"), ("example.com", ""), ("", ""), ("a.org", "/https://b.net/es/")]
    assert {i: out[i].rule for i in out} == {
        1: None, 2: None, 3: "www.example.com/en/", 4: None, 5: "com/", 6: "example.com/en/", 7: "net/fr/", 8: None,
        9: None, 10: "com/", 11: None}
    assert (out[3].verdict, out[6].verdict, out[7].verdict) == ("allow", "block", "block")
    assert {r.verdict for r in out.values()} <= {"allow", "block"}


def test_url_method_learns_from_the_labelled_table(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    df = spark.createDataFrame([("a", "http://cheap-pills.example.org/x"), ("b", "http://weather.example.org/x")],
                               "page_id string, url string")
    out = url_filter.judge_urls(df, "page_id", "url", model)
    assert {r.id: r.verdict for r in out.collect()} == {"a": "block", "b": "allow"}
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_shards_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "x") for i in range(20)], "id long, text string, shard string")
    sharding.write_shards(df, "id", F.octet_length("text"), 20, str(tmp_path / "named"))
    back = spark.read.parquet(str(tmp_path / "named"))
    assert sorted(back.columns) == ["_shard", "id", "shard", "text"] and back.count() == 20 and back.where("shard = 'x'").count() == 20
    sharding.write_shards(df.where("false"), "id", F.octet_length("text"), 20, str(tmp_path / "none"))
    empty = spark.read.parquet(str(tmp_path / "none"))
    assert empty.count() == 0 and "text" in empty.columns


def test_verdicts_follow_from_the_fitted_weights(spark):
    """The regression scored by hand: hashed n-grams counted, weighed and put through the sigmoid."""
    from pyspark.ml.feature import HashingTF
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = ["https://news.test/a/b", "http://cheap-pills.test/buy?x", "x", None, "ftp://Casino.example.org/WIN#1", "http://"]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "i int, u string"), "i", "u", model, rules=()).collect()}
    place = HashingTF(numFeatures=url_filter.WEIGHTS).indexOf
    weights = model.coefficients.toArray()
    for i, r in got.items():
        texts = {"h": f"^{r.host}$", "p": r.path}
        grams = [m + t[j:j + n] for m, t in texts.items() for n in url_filter.SIZES for j in range(len(t) - n + 1)]
        score = model.intercept + sum(weights[place(g)] for g in grams)
        assert r.method_verdict == ("block" if score > 0 else "allow") and r.verdict == r.method_verdict
