"""Packed arrays, pairs of hot values, one comparison for several runs."""

from pyspark.sql import functions as F

from ledgerline.functions.packing import END, ESCAPE, pack, unpack
from ledgerline.operators import reconcile as RC
from ledgerline.plans import invoices as I


def test_any_array_comes_back(spark):
    given = [None, [], [""], ["", ""], ["a", None, "b"], [None], [ESCAPE + "N"], [END, ESCAPE, ESCAPE + "S", "x" + END + ESCAPE + "E"],
             ["a" + END + "b"], ["a", "b"], ["ä", "\n\\Q*"]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v array<string>")
    packed = rows.select("i", "v", pack(F.col("v")).alias("p"))
    got = {r.i: r.u for r in packed.select("i", unpack(F.col("p")).alias("u")).collect()}
    assert [got[i] for i in range(len(given))] == given
    assert packed.where("p is not null").select("p").distinct().count() == len(given) - 1


def test_pairs_of_a_hot_value(spark, monkeypatch):
    def keys(side, n):
        return spark.range(n).select(F.format_string(side + "%05d", "id").alias("doc_id"), F.lit(0).alias("tx_index"), F.when(
            F.col("id") % 4 == 0, F.concat(F.lit("k"), F.col("id"))).otherwise("hot").alias("match_value"))
    src, tgt = keys("s", 900), keys("t", 700)
    want = sorted(map(tuple, RC.pair_documents(src, tgt).collect()), key=repr)
    monkeypatch.setattr(RC, "HOT_ROWS", 100)
    assert sorted(map(tuple, RC.pair_documents(src, tgt).collect()), key=repr) == want
    hot = {r[2]: (r[3], r[5]) for r in want if r[1] == "hot"}
    assert len(hot) == 675 and hot[1] == ("s00001", "t00001") and hot[600][1] is None


def test_stored_runs_compare_the_books_once(spark, sf, monkeypatch):
    calls, align = [], RC.align
    monkeypatch.setattr(RC, "align", lambda *a: calls.append(1) or align(*a))
    monkeypatch.setattr(I, "_stores", {})
    I.run_store(spark, sf)
    I.flat_run(spark, sf, 0, inputs=I.stored_inputs(spark, sf))
    assert len(calls) == 1


def test_records_on_one_side_and_marks_in_values(spark):
    schema = "doc_id string, tx_index int, section string, occ int, fields array<struct<field: string, value: string>>"
    src = spark.createDataFrame([("s", 0, "line", 0, [("a", "x" + END), ("b", None)]), ("s", 0, "line", 1, [("a", "1")]),
                                 ("alone", 0, "line", 0, [("a", "1")])], schema)
    tgt = spark.createDataFrame([("t", 0, "line", 0, [("a", "x" + ESCAPE), ("b", None)])], schema)
    pairs = spark.createDataFrame([("p#1", "p", 1, "s", 0, "t", 0), ("q#1", "q", 1, "alone", 0, None, None)],
                                  "pair_id string, match_value string, occ int, source_file string, source_tx int, target_file string, target_tx int")
    got = {(r.pair_id, r.segment, r.field): (r.source_value, r.target_value)
           for r in RC.diff_flat(spark, pairs, src, tgt, I.profile_rules(1)).collect()}
    assert got == {("p#1", "line_0", "a"): ("x" + END, "x" + ESCAPE), ("p#1", "line_1", ""): ("{'a': '1'}", None)}


def _books(spark, path):
    """Orders and lines with a repeated order, repeated lines, orders without lines and lines without an order."""
    orders = spark.range(120).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "id * 1.5D as o_totalprice",
                                         "timestamp'1996-01-02' as o_orderdate", "'1-URGENT' as o_orderpriority")
    orders.union(orders.where("o_orderkey in (14, 17, 26)")).write.parquet(f"{path}/orders.parquet")
    lines = spark.range(500).selectExpr(
        "id % 130 as l_orderkey", "id as l_partkey", "id % 11 as l_suppkey", "cast(id div 130 as int) as l_linenumber", "2D as l_quantity",
        "3.5D as l_extendedprice", "0.05D as l_discount", "0.01D as l_tax", "'N' as l_returnflag", "'F' as l_linestatus",
        "timestamp'1996-02-03' as l_shipdate").where("l_orderkey % 10 <> 3")
    lines.union(lines.where("l_partkey % 50 = 17")).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_records_that_know_their_pair_give_the_same_diffs(spark, tmp_path):
    books = _books(spark, tmp_path)
    src, tgt = I.invoice_records(spark, books, "source"), I.invoice_records(spark, books, "target")
    pairs = RC.pair_documents(RC.match_values_flat(src, I.MATCH_KEY), RC.match_values_flat(tgt, I.MATCH_KEY))
    want = RC.diff_flat(spark, pairs, src, tgt, I.profile_rules(1)).collect()
    known_pairs, diffs = I.flat_run(spark, books)
    assert sorted(map(tuple, known_pairs.collect()), key=repr) == sorted(map(tuple, pairs.collect()), key=repr)
    assert sorted(map(tuple, diffs.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert known_pairs.columns == pairs.columns and any(r.segment == "line_1" for r in want) and any(r.field == "" for r in want)
    src, tgt, _ = I.flat_inputs(spark, books)
    for side, records in (("source", src), ("target", tgt)):
        whole = I.invoice_records(spark, books, side)
        assert sorted(map(tuple, records.drop("pair_id").collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_records_that_know_their_pair_are_not_joined_to_pairs(spark, sf, monkeypatch):
    src, tgt, pairs = I.flat_inputs(spark, sf)
    stored, keep = [], RC.store
    monkeypatch.setattr(RC, "store", lambda df: stored.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    RC.align_flat(pairs, src, tgt, [])
    assert len(stored) == 1 and "Join FullOuter" in stored[0] and "Join Inner" not in stored[0]


def test_keys_are_counted_one_by_one_only_in_full_groups(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("case when id % 2 = 0 then 'hot' else concat('k', id) end as k")
    monkeypatch.setattr(RC, "HOT_ROWS", 499)
    monkeypatch.setattr(RC, "HOT_GROUPS", 2)
    assert [r.k for r in RC._hot_keys(rows, "k").collect()] == ["hot"]
    assert RC._hot_keys(rows.where("k <> 'hot'"), "k") is None
    monkeypatch.setattr(RC, "HOT_ROWS", 300)
    monkeypatch.setattr(RC, "HOT_GROUPS", 1)
    assert RC._hot_keys(rows.where("k <> 'hot'"), "k") is None


def test_records_of_one_order_do_not_move(spark, tmp_path, monkeypatch):
    books = _books(spark, tmp_path)
    stored, keep = [], RC.store
    monkeypatch.setattr(RC, "store", lambda df: stored.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    I.aligned(spark, books)
    plan = stored[-1]
    assert "Join FullOuter" not in plan and "FullOuter" not in plan and "Exchange hashpartitioning(pair_id" not in plan
    places = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert places and all("orderkey" in line for line in places)  # orders, lines and pairs, never records


def test_pairs_of_one_order_and_of_two_give_the_same_diffs(spark, tmp_path, monkeypatch):
    books = _books(spark, tmp_path)
    for name in ("customer", "total"):  # most pairs link two orders; some pairs do
        monkeypatch.setattr(I, "MATCH_KEY", RC.PathKey().clean(f"header.{name}", r"\..*$|"))
        src, tgt = I.invoice_records(spark, books, "source"), I.invoice_records(spark, books, "target")
        pairs = RC.pair_documents(RC.match_values_flat(src, I.MATCH_KEY), RC.match_values_flat(tgt, I.MATCH_KEY))
        ends = pairs.selectExpr("regexp_extract(source_file, '([0-9]+)') as s", "regexp_extract(target_file, '([0-9]+)') as t")
        assert ends.where("s = t").count() and ends.where("s <> t").count()
        want = RC.diff_flat(spark, pairs, src, tgt, I.profile_rules(1)).collect()
        assert sorted(map(tuple, I.flat_run(spark, books)[1].collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_records_in_place_meet_as_in_a_join(spark):
    rows = spark.createDataFrame([(1, "p", True, "a"), (1, "p", True, "b"), (1, "p", False, "a"), (1, "p", False, None), (2, "q", True, "c"),
                                  (3, "r", False, "c"), (4, "s", True, "d"), (4, "s", False, "d")],
                                 "place int, pair_id string, source boolean, values string").selectExpr("*", "'n' as names")
    def side(on, p):
        return rows.where("source" if on else "not source").selectExpr("pair_id", f"names as _{p}n", f"values as _{p}v")

    met, joined = (sorted(map(tuple, RC._unequal(j).collect()), key=repr)
                   for j in (RC._meet(rows, ["pair_id"]), side(True, "s").join(side(False, "t"), ["pair_id"], "full_outer")))
    assert met == joined and len(met) == 5
