"""JSON documents: read, write, split, flatten, golden compare (S18–S20, A15,
P1, P11, C30, T9, T15).

The pipeline's output document is ``{header, lines[], summary, envelope}``.
In Spark it is a struct column; JSON text is only produced at the sink and
parsed with a declared schema on the way back (``from_json``), so nothing is
inferred per file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.reconcile import FIELD_STRUCT, occurrence_numbers
from ledgerline.session import store


def clean_nan(content: Column) -> Column:
    """Bare ``NaN`` tokens (pandas output, not JSON) become ``null``."""
    return F.regexp_replace(content, r"(:\s*|\[\s*|,\s*)-?NaN(\s*[,}\]])", "$1null$2")


def read_json_docs(files: DataFrame, schema: T.StructType | str, content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Parse with a declared schema; unreadable files are reported, not fatal.

    Returns ``(docs, failures)``; ``docs`` has a ``doc`` struct column.
    """
    parsed = files.withColumn("doc", F.from_json(clean_nan(F.col(content_col)), schema, {"mode": "PERMISSIVE"}))
    bad = (F.col("doc").isNull()) | (F.try_parse_json(clean_nan(F.col(content_col))).isNull())
    failures = parsed.filter(bad).select("path", F.lit("PARSE_FAIL").alias("code"))
    return parsed.filter(~bad), failures


def to_json_docs(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """S19 (text): one JSON document per row; NULLs are written as ``null``, never NaN."""
    return docs.select("path", F.to_json(F.col(doc_col), {"ignoreNullFields": "false"}).alias("content"))


def write_json_docs(docs: DataFrame, out_dir: str, doc_col: str = "doc", by: str = "source_file") -> None:
    """S19 sink: JSON lines partitioned by source file (one directory per input)."""
    docs.select(by, F.col(doc_col).alias("document")).write.mode("append").partitionBy(by).json(out_dir)


def split_documents(lines: DataFrame, key_col: str, file_col: str = "path", order_col: str = "row_no") -> DataFrame:
    """Lines with the document that they belong to, one row per line.

    Documents are per (file, key); lines without a key form the ``unknown`` remainder,
    flagged ``is_split_remainder`` (and excluded from pairing later).  ``occ`` numbers a
    document's lines from 1 in file order; the numbering splits hot keys, and no document
    is gathered into one row.  ``order_col`` is unique within a file.
    """
    key = F.col(key_col).cast("string")
    blank = key.isNull() | (F.btrim(key) == "")
    doc = F.to_json(F.struct(F.col(file_col).alias("f"), F.when(blank, F.lit("unknown")).otherwise(key).alias("k"),
                             blank.alias("r")))
    rows = lines.withColumns({"split_key": F.when(blank, F.lit("unknown")).otherwise(key),
                              "is_split_remainder": blank, "_doc": doc})
    return occurrence_numbers(rows, "_doc", [order_col]).drop("_doc", "_cnt")


def write_split_documents(split: DataFrame, out_dir: str, file_col: str = "path") -> None:
    """S20 sink: JSON lines under one folder for each file and key."""
    split.write.mode("append").partitionBy(file_col, "split_key", "is_split_remainder").json(out_dir)


def split_summary(lines: DataFrame, key_col: str, file_col: str = "path") -> DataFrame:
    """A15 aggregate form of the split: lines and remainder flag per (file, key)."""
    key = F.col(key_col).cast("string")
    blank = key.isNull() | (F.btrim(key) == "")
    return (lines.groupBy(F.col(file_col), F.when(blank, F.lit("unknown")).otherwise(key).alias("split_key"),
                          blank.alias("is_split_remainder"))
                 .agg(F.count(F.lit(1)).alias("n_lines"))
                 .withColumn("match_value", F.when(~F.col("is_split_remainder"), F.col("split_key"))))


def _text(c: Column) -> Column:
    """Python ``str()`` of a JSON scalar: NULL -> 'None', booleans True/False."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def records_from_docs(docs: DataFrame, doc_col: str = "doc", key_cols: list[str] | None = None) -> DataFrame:
    """Records (header / line / summary) of structured documents for reconciliation."""
    dt = docs.schema[doc_col].dataType
    keys = key_cols or ["path"]

    def fields(c: Column, st: T.StructType) -> Column:
        arr = F.array(*[F.struct(F.lit(f.name).alias("field"), _text(c[f.name]).alias("value")) for f in st.fields])
        return arr.cast(FIELD_STRUCT)

    out = []
    for sec in ("header", "summary"):
        if sec in dt.names:
            st = dt[sec].dataType
            out.append(docs.select(F.col(keys[0]).alias("doc_id"), F.lit(0).alias("tx_index"), F.lit(sec).alias("section"),
                                   F.lit(0).alias("occ"), fields(F.col(f"{doc_col}.{sec}"), st).alias("fields")))
    if "lines" in dt.names:
        st = dt["lines"].dataType.elementType
        ex = docs.select(F.col(keys[0]).alias("doc_id"), F.posexplode(f"{doc_col}.lines").alias("occ", "_l"))
        out.append(ex.select("doc_id", F.lit(0).alias("tx_index"), F.lit("line").alias("section"), "occ",
                             fields(F.col("_l"), st).alias("fields")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def records_from_text(files: DataFrame, path_col: str = "path", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Records of JSON documents of any schema, and the files that are no JSON object.

    A document with a ``header``, ``lines`` or ``summary`` gives one record for each of its
    sections and lines; any other is truly flat: one record of section ``flat`` with its
    top-level fields.  Fields keep file order; values are the JSON text of what is there
    (strings without quotes, null as ``None``, T9)."""
    text = clean_nan(F.col(content_col))
    whole = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    read = files.select(F.col(path_col).alias("doc_id"), whole.alias("_doc"))
    failures = read.where("_doc is null").select(F.col("doc_id").alias("path"), F.lit("PARSE_FAIL").alias("code"))

    def fields(m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.struct(
            e["key"].alias("field"), F.coalesce(e["value"], F.lit("None")).alias("value"))).cast(FIELD_STRUCT)

    def record(section: str, m: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(0).alias("occ"), fields(m).alias("fields"))

    def part(name: str, kind: str) -> Column:
        return F.from_json(F.element_at("_doc", F.lit(name)), kind, {"mode": "PERMISSIVE"})

    parts = read.where("_doc is not null").select(
        "doc_id", "_doc", part("header", "map<string,string>").alias("_h"), part("summary", "map<string,string>").alias("_s"),
        part("lines", "array<map<string,string>>").alias("_l"))
    nested = F.arrays_overlap(F.map_keys("_doc"), F.array(F.lit("header"), F.lit("lines"), F.lit("summary")))
    lines = F.transform(F.coalesce("_l", F.array().cast("array<map<string,string>>")), lambda m, i: F.struct(
        F.lit("line").alias("section"), i.alias("occ"), fields(m).alias("fields")))
    heads = F.filter(F.array(F.when(F.col("_h").isNotNull(), record("header", F.col("_h"))),
                             F.when(F.col("_s").isNotNull(), record("summary", F.col("_s")))), lambda r: r.isNotNull())
    records = F.when(nested, F.concat(heads, lines)).otherwise(F.array(record("flat", F.col("_doc"))))
    return parts.select("doc_id", F.lit(0).alias("tx_index"), F.explode(records).alias("_r")).select(
        "doc_id", "tx_index", "_r.section", "_r.occ", "_r.fields"), failures


# ------------------------------------------------------------------ golden comparison

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, _NUM):
        return "int"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "str"


def _leaf(path: Column, value: Column, dt: T.DataType) -> Column:
    kind = _kind(dt)
    numeric = kind in ("int", "float")
    return F.struct(path.alias("path"), F.when(value.isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("type"),
                    (F.lit(None).cast("string") if numeric else value.cast("string")).alias("text"),
                    (value.cast("double") if numeric else F.lit(None).cast("double")).alias("num"))


def _walk(df: DataFrame, key: str, value: Column, dt: T.DataType, path: Column, skip: set[str],
          leaves: list[DataFrame], lengths: list[DataFrame]) -> None:
    """Scalars below ``value`` as rows (key, v, within) and its lists as rows (key, path, n).
    ``df`` carries ``_in``, the lists around ``value``.  The walk follows the declared
    schema when the plan is built: structs inside structs, lists inside lists."""
    scalars, lists = [], []

    def collect(c: Column, t: T.DataType, at: Column) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                if f.name not in skip:
                    collect(c[f.name], f.dataType, F.concat(at, F.when(at == "", "").otherwise("."), F.lit(f.name)))
        elif isinstance(t, T.ArrayType):
            lists.append((at, c, t.elementType))
        else:
            scalars.append(_leaf(at, c, t))

    collect(value, dt, path)
    if scalars:
        leaves.append(df.select(key, F.explode(F.array(*scalars)).alias("v"), F.col("_in").alias("within")))
    for at, c, element in lists:
        lengths.append(df.select(key, at.alias("path"), F.size(c).alias("n")))
        inside = df.select(key, F.concat("_in", F.array(at)).alias("_in"), at.alias("_at"), F.posexplode(c).alias("_i", "_e"))
        inside = inside.select(key, "_in", "_e", F.concat("_at", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("_p"))
        _walk(inside, key, F.col("_e"), element, F.col("_p"), skip, leaves, lengths)


def _leaf_rows(df: DataFrame, doc_col: str, key: str, skip: set[str]) -> tuple[DataFrame, DataFrame]:
    leaves: list[DataFrame] = []
    lengths: list[DataFrame] = []
    rows = df.withColumn("_in", F.array().cast("array<string>"))
    _walk(rows, key, F.col(doc_col), df.schema[doc_col].dataType, F.lit(""), skip, leaves, lengths)
    none = df.where("false")
    leaves = leaves or [none.select(key, _leaf(F.lit(""), F.lit(""), T.StringType()).alias("v"),
                                    F.array().cast("array<string>").alias("within"))]
    lengths = lengths or [none.select(key, F.lit("").alias("path"), F.lit(0).alias("n"))]
    return (reduce(DataFrame.unionByName, leaves).select(key, "v.*", "within"), reduce(DataFrame.unionByName, lengths))


def _differs(e: Column, a: Column, tolerance: float) -> Column:
    """Whether two leaves (of :func:`_leaf`) of one path differ."""
    same_num = (e["type"] == a["type"]) & e["type"].isin("int", "float")
    both_nan = (e["type"] == "float") & (a["type"] == "float") & F.isnan(e["num"]) & F.isnan(a["num"])
    both_num = e["type"].isin("int", "float") & a["type"].isin("int", "float")
    return (F.when(both_nan, F.lit(False))
             .when(same_num, F.abs(a["num"] - e["num"]) >= tolerance)
             .when(both_num, a["num"] != e["num"])
             .otherwise((e["type"] != a["type"]) | ~e["text"].eqNullSafe(a["text"])))


_FOUND = "struct<path:string,kind:string,expected:string,actual:string,expected_num:double,actual_num:double>"


def _found(path: Column, kind: str, expected=None, actual=None, expected_num=None, actual_num=None) -> Column:
    """A row of the comparison."""
    return F.struct(path, F.lit(kind), *[F.lit(None) if c is None else c for c in (expected, actual, expected_num, actual_num)]).cast(_FOUND)


def _comparable(dt: T.DataType) -> bool:
    """Whether paths of the schema are unique, and whole values of it can be told equal."""
    if isinstance(dt, T.StructType):
        return all(f.name and not {".", "["} & set(f.name) and _comparable(f.dataType) for f in dt.fields)
    return _comparable(dt.elementType) if isinstance(dt, T.ArrayType) else not isinstance(dt, (T.MapType, T.VariantType))


#: A value of one side and its type.
_Value = tuple[Column, T.DataType]


def _compared(e: _Value | None, a: _Value | None, path: Column, root: bool, skip: set[str], tolerance: float,
              lengths: bool = False) -> list[Column]:
    """What differs between two values of one path, as columns of arrays of :data:`_FOUND`; None: the
    side has nothing there.  The walk follows the schemas when the plan is built, like :func:`_walk`.
    ``lengths``: only of lists inside; those of a list whose own length differs are still told."""
    def kind(v: _Value | None) -> str | None:
        return v and {T.StructType: "struct", T.ArrayType: "list"}.get(type(v[1]), "leaf")

    if e and a and kind(e) != kind(a):  # no path of the one is a path of the other
        return _compared(e, None, path, root, skip, tolerance, lengths) + _compared(None, a, path, root, skip, tolerance, lengths)
    if lengths and not (e and a):
        return []
    what, none = kind(e) or kind(a), F.array().cast(f"array<{_FOUND}>")
    if what == "struct":
        def member(v: _Value | None, name: str) -> _Value | None:
            return (v[0][name], v[1][name].dataType) if v and name in v[1].names else None

        names = dict.fromkeys(n for v in (e, a) if v for n in v[1].names if n not in skip)
        parts = [_compared(member(e, n), member(a, n), F.lit(n) if root else F.concat(path, F.lit(f".{n}")), False, skip, tolerance,
                           lengths) for n in names]
        return [c for part in parts for c in part]
    if what == "leaf":
        if lengths:
            return []
        el, al = (_leaf(path, *v) if v else None for v in (e, a))
        if e and a:
            return [F.when(_differs(el, al, tolerance), F.array(_found(path, "value", el["text"], al["text"], el["num"], al["num"]))).otherwise(none)]
        if e:
            return [F.array(_found(path, "missing", el["text"], None, el["num"]))]
        return [F.array(_found(path, "unexpected", None, al["text"], None, al["num"]))]

    def elements(pairs: Column, both: bool, of_e: bool, of_a: bool, only: bool = False) -> Column:
        def rows(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            sides = ((x["e"] if both else x, e[1].elementType) if of_e else None, (x["a"] if both else x, a[1].elementType) if of_a else None)
            parts = _compared(*sides, at, False, skip, tolerance, only)
            found = F.concat(*parts) if parts else none
            if both and tolerance > 0 and e[1].elementType == a[1].elementType and _comparable(e[1].elementType):
                return F.when(x["e"].eqNullSafe(x["a"]), none).otherwise(found)
            return found
        return F.coalesce(F.flatten(F.transform(pairs, rows)), none)

    if not (e and a):
        return [elements((e or a)[0], False, bool(e), bool(a))]
    n, m = F.size(e[0]), F.size(a[0])
    length = F.array(_found(path, "length", n.cast("string"), m.cast("string")))
    pairs = F.zip_with(e[0], a[0], lambda x, y: F.struct(x.alias("e"), y.alias("a")))
    inside = elements(F.slice(pairs, 1, F.least(n, m)), True, True, True, True)
    differ = F.when(n != m, F.concat(length, inside))
    if lengths:
        return [differ.when(n == m, inside).otherwise(none)]
    return [F.when(e[0].isNull(), elements(a[0], False, False, True)).when(a[0].isNull(), elements(e[0], False, True, False))
             .otherwise(differ.otherwise(elements(pairs, True, True, True)))]


def deep_diff(expected: DataFrame, actual: DataFrame, key: str = "doc", doc_col: str = "doc",
              skip: set[str] | None = None, tolerance: float = 0.01) -> DataFrame:
    """Path-wise comparison of two document sets paired by ``key``.

    Missing / unexpected keys, one row per list whose length differs (its
    elements are then not compared), numbers of the same type compared with
    ``tolerance``, NaN equal to NaN, everything else by text.  A document on one
    side only is one row of kind ``missing_document`` or ``unexpected_document``.

    The two documents of a key meet in one full outer join and are compared within the row, so a
    document moves once and only what differs becomes rows.  Keys that a side has more than once are
    compared by their leaves (:func:`_by_leaves`), as are schemas with names that look like paths.
    The inputs are read twice, for their keys and for their documents.
    """
    skip = skip or set()
    columns = [key, "path", "kind", "expected", "actual", "expected_num", "actual_num"]
    types = [df.schema[doc_col].dataType for df in (expected, actual)]
    some = True
    if all(map(_comparable, types)):
        several = [store(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)) for df in (expected, actual)]
        some = not all(df.isEmpty() for df in several)
        several = several[0].unionByName(several[1]).distinct()
    if some:
        if not all(map(_comparable, types)):
            several = expected.select(key).where(F.col(key).isNotNull()).distinct()
        own = [df.join(several, key, "left_semi") for df in (expected, actual)]
        expected, actual = (df.join(several, key, "left_anti") for df in (expected, actual))
    e, a = (df.select(key, F.col(doc_col).alias(f"_{x}"), F.lit(True).alias(f"_has_{x}")) for df, x in ((expected, "e"), (actual, "a")))
    both = e.join(a, key, "full_outer")

    def alone(kind: str) -> Column:
        return F.array(_found(F.lit(""), kind))

    parts = _compared((F.col("_e"), types[0]), (F.col("_a"), types[1]), F.lit(""), True, skip, tolerance)
    rows = F.when(F.col("_has_a").isNull(), alone("missing_document")).when(F.col("_has_e").isNull(), alone("unexpected_document")).otherwise(
        F.concat(F.array().cast(f"array<{_FOUND}>"), *parts))
    found = both.select(key, F.explode(rows).alias("_f")).select(key, "_f.*").select(columns)
    return found.unionByName(_by_leaves(*own, key, doc_col, skip, tolerance)) if some else found


def _by_leaves(expected: DataFrame, actual: DataFrame, key: str, doc_col: str, skip: set[str], tolerance: float) -> DataFrame:
    """:func:`deep_diff` by a join of leaves: each leaf of a key and path meets each of the other side,
    and a list whose length differs in any two documents of a key is not compared in any."""
    alone = []
    for here, there, kind in ((expected, actual, "missing_document"), (actual, expected, "unexpected_document")):
        alone.append(here.select(key).join(there.select(key), key, "left_anti").select(
            key, F.lit("").alias("path"), F.lit(kind).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (
                ("expected", "string"), ("actual", "string"), ("expected_num", "double"), ("actual_num", "double"))]))
    # each level of the documents is read by itself, so they are made and joined once
    expected, actual = (store(expected.join(actual.select(key), key, "left_semi")),
                        store(actual.join(expected.select(key), key, "left_semi")))
    e_rows, e_len = _leaf_rows(expected, doc_col, key, skip)
    a_rows, a_len = _leaf_rows(actual, doc_col, key, skip)
    lj = e_len.alias("e").join(a_len.alias("a"), [key, "path"])
    length = lj.filter(F.col("e.n") != F.col("a.n")).select(
        key, "path", F.lit("length").alias("kind"), F.col("e.n").cast("string").alias("expected"),
        F.col("a.n").cast("string").alias("actual"), F.lit(None).cast("double").alias("expected_num"),
        F.lit(None).cast("double").alias("actual_num"))
    bad_lists = lj.filter(F.col("e.n") != F.col("a.n")).select(F.col(key).alias("_bk"), F.col("path").alias("_lp"))
    j = (e_rows.alias("e").join(a_rows.alias("a"), [key, "path"], "full_outer")
               .join(bad_lists, (F.col(key) == F.col("_bk"))
                     & F.array_contains(F.coalesce("e.within", "a.within"), F.col("_lp")), "left_anti"))
    leaves = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("type", "text", "num")]) for x in "ea"]
    value_bad = _differs(*leaves, tolerance)
    kind = (F.when(F.col("a.type").isNull(), F.lit("missing")).when(F.col("e.type").isNull(), F.lit("unexpected"))
             .when(value_bad, F.lit("value")))
    vals = j.select(key, "path", kind.alias("kind"), F.col("e.text").alias("expected"), F.col("a.text").alias("actual"),
                    F.col("e.num").alias("expected_num"), F.col("a.num").alias("actual_num")).filter(F.col("kind").isNotNull())
    return vals.unionByName(length).unionByName(alone[0]).unionByName(alone[1])
