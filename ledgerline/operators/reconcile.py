"""Reconciliation of two sets of documents.

Data model
----------
A *record* is one addressable unit of a document: the header, one line, the
summary, or one X12 segment.  Both sides arrive as record tables::

    doc_id  tx_index  section  seg  seg_pos  occ  fields: array<struct<field, value>>

``section`` is ``header | line | summary | flat`` for flat documents and
``x12`` for segments.  ``fields`` keeps file order; an absent field has no
entry, a JSON null has the value ``'None'`` (T9).

Plan
----
1. ``pair_documents``: match values per transaction, occurrence numbering inside
   a value, full outer join on (value, occurrence) – one shuffle at document grain.
2. Records move to the place of their pair: target records join it first, source records are
   there by their own document.  Records that already have their ``pair_id`` skip this.
3. The two sides meet at *record* grain on (pair, seg, qualifier, occurrence), by a window in the
   place, or by a full outer join where records know their pair and move to it.  A record's
   fields are one packed string until then, and equal records go before they are unpacked.  A
   record present on one side only is one presence diff (missing line / segment); the fields of
   records present on both sides are zipped inside the row (``map_zip_with``) and exploded.
   What differs is stored.
4. Equal text is dropped before any rule work (it is never a diff), then the
   ignore list (broadcast anti joins), then rule resolution (broadcast joins).  Runs that
   differ only in rules share what differs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.packing import pack, unpack
from ledgerline.functions.transforms import as_double, normalize
from ledgerline.operators import rules as R
from ledgerline.session import store
from ledgerline.sources.x12 import segments_of

COMPOSITE_SEP = "\x1f"

FIELD_STRUCT = T.ArrayType(T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("value", T.StringType()),
]))

DIFF_COLUMNS = ["pair_id", "segment", "field", "severity", "source_value", "target_value",
                "description", "wildcard"]


class _Key:
    """Places whose values make up a match value, each with an optional clean-up pattern.
    The two kinds below read different documents, so a key cannot mix them (C3)."""

    def __init__(self, *places: str):
        """``places`` are read as they are; ``clean`` adds a place with its pattern."""
        self.places: list[tuple[str, str | None]] = [(p, None) for p in places]

    def clean(self, place: str, pattern: str):
        self.places.append((place, pattern))
        return self

    def __iter__(self):
        if not self.places:
            raise ValueError(f"{type(self).__name__} names no place")
        return iter(self.places)


class PathKey(_Key):
    """Paths of flat documents, like ``header.invoice_number``."""


class ElementKey(_Key):
    """X12 elements by their reference, like ``BIG02`` or ``N104``."""


def fields_map(fields: Column) -> Column:
    """Field name -> value; of a name that occurs more than once the last value stays."""
    later = F.filter(fields, lambda x, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)),
                                                     lambda y: y["field"] == x["field"]))
    names = F.transform(fields, lambda x: x["field"])
    return F.map_from_entries(F.when(F.size(F.array_distinct(names)) < F.size(names), later).otherwise(fields))


# ------------------------------------------------------------------ match keys

def match_values_flat(records: DataFrame, key: PathKey, carry: list[str] | None = None) -> DataFrame:
    """Match value from a header path of flat documents.

    A path is ``header.<field>`` (or a bare field of a truly flat
    document).  Empty or missing values give no entry; split remainders
    (``_is_split_remainder`` true in the header) are excluded (P11).
    Output: (doc_id, tx_index, match_value) and the columns of the header named in ``carry``.
    """
    carry = carry or []
    if not isinstance(key, PathKey):
        raise TypeError("flat documents are matched by a PathKey")
    places = list(key)
    head = records.filter(F.col("section").isin("header", "flat"))
    fmap = fields_map(F.col("fields"))
    cols = []
    for i, (place, pattern) in enumerate(places):
        sec, _, name = place.rpartition(".")
        sec = sec.split(".")[0] or "flat"
        v = F.when(F.col("section") == sec, F.element_at(fmap, F.lit(name)))
        # emptiness is checked on the raw value; normalising may yield ''
        cols.append(normalize(F.when(v != "", v), pattern).alias(f"_k{i}"))
    rem = F.coalesce(F.lower(F.element_at(fmap, F.lit("_is_split_remainder"))).isin("true", "1"),
                     F.lit(False))
    k = head.select("doc_id", "tx_index", rem.alias("_rem"), *cols, *carry)
    parts = [f"_k{i}" for i in range(len(places))]
    k = (k.groupBy("doc_id", "tx_index")
          .agg(F.max("_rem").alias("_rem"), *[F.max(c).alias(c) for c in [*parts, *carry]]))
    value = F.concat_ws(COMPOSITE_SEP, *[F.col(c) for c in parts])
    ok = ~F.col("_rem")
    for c in parts:
        ok = ok & F.col(c).isNotNull()
    return k.filter(ok).select("doc_id", "tx_index", value.alias("match_value"), *carry)


def x12_field_index(field: str) -> int:
    """'BIG02' -> 2."""
    digits = "".join(ch for ch in field if ch.isdigit())
    return int(digits[-2:]) if digits else 0


def match_values_x12(segments: DataFrame, key: ElementKey) -> DataFrame:
    """Per transaction, the first segment of the part's id with a non-empty
    element; composite parts must all resolve (strict AND).

    ``segments`` are transaction segments (``sources.x12.transactions``).
    Output: (doc_id, tx_index, match_value).
    """
    if not isinstance(key, ElementKey):
        raise TypeError("X12 documents are matched by an ElementKey")
    places, aggs = list(key), []
    # a transaction without a segment of some part has no value
    segments = segments.where(F.col("segment").isin(sorted({place[:-2] for place, _ in places})))
    for i, (place, pattern) in enumerate(places):
        v = F.get(F.col("elements"), F.lit(x12_field_index(place)))
        hit = (F.col("segment") == place[:-2]) & v.isNotNull() & (v != "")
        aggs.append(F.min_by(F.when(hit, normalize(v, pattern)),
                             F.when(hit, F.col("seg_pos"))).alias(f"_k{i}"))
    k = segments.groupBy("doc_id", "tx_index").agg(*aggs)
    parts = [F.col(f"_k{i}") for i in range(len(places))]
    ok = F.lit(True)
    for c in parts:
        ok = ok & c.isNotNull()
    return k.filter(ok).select("doc_id", "tx_index", F.concat_ws(COMPOSITE_SEP, *parts).alias("match_value"))


def key_diagnostics(all_docs: DataFrame, keys: DataFrame, side: str, failures: DataFrame | None = None) -> DataFrame:
    """C4: why documents of a side take no part: they could not be read (``failures``: their
    ``path``; PARSE_FAIL) or gave no match value (NO_MATCH_VALUES)."""
    notes = (all_docs.select("doc_id").distinct()
                     .join(keys.select("doc_id"), "doc_id", "left_anti")
                     .select(F.lit(side).alias("side"), "doc_id", F.lit("NO_MATCH_VALUES").alias("code")))
    if failures is None:
        return notes
    return notes.unionByName(failures.select(F.lit(side).alias("side"), F.col("path").alias("doc_id"),
                                             F.lit("PARSE_FAIL").alias("code")))


# ------------------------------------------------------------------ pairing

#: Rows of one key that a single task numbers; keys of more are split over tasks.
HOT_ROWS = 200_000

#: Keys are first counted in this many groups by hash; a group of few rows has no hot key.
HOT_GROUPS = 4096


def _hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of more than :data:`HOT_ROWS` rows, or None.  Only keys of a group with that
    many rows are counted one by one, so usually no key is shuffled for this."""
    group = F.pmod(F.xxhash64(key), F.lit(HOT_GROUPS))
    full = rows.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select("_g")
    if not full.take(1):
        return None
    hot = (rows.withColumn("_g", group).join(F.broadcast(full), "_g", "left_semi")
               .groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(key))
    return F.broadcast(hot) if hot.take(1) else None


def occurrence_numbers(df: DataFrame, key: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``occ`` = 1, 2, … per ``key`` (and ``within``) in ``order`` – exact and skew-safe.

    Rows are partitioned by ``key`` and numbered by a window.  A window sorts every row of a
    key in one task; a key shared by a third of all documents would stall the job, so keys
    of more than :data:`HOT_ROWS` rows are numbered over many tasks (``_split_numbers``).
    There are at most rows / ``HOT_ROWS`` of these, a table that is broadcast.  Rows without a
    key have no number and are left out.
    """
    by = [key, *(within or [])]
    rows = store(df.where(F.col(key).isNotNull()))
    hot = _hot_keys(rows, key)
    w = Window.partitionBy(*by).orderBy(*order)

    def by_window(part: DataFrame) -> DataFrame:
        return part.repartition(key).withColumn("occ", F.row_number().over(w))

    if hot is None:
        return by_window(rows)
    return by_window(rows.join(hot, key, "left_anti")).unionByName(
        _split_numbers(rows.join(hot, key, "left_semi"), by, order))


def _split_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Numbers of keys with many rows: the rows are range-partitioned by (key, order…) – the
    range sampler splits a hot key across many partitions – numbered locally per
    (partition, key), and shifted by the counts of the same key in earlier
    partitions (a small per-(partition, key) table).
    """
    ranged = (df.repartitionByRange(*by, *order)
                .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *by).orderBy(*order)
    # range bounds are sampled anew for each plan node, so rows and counts must come from
    # one computation: the numbered rows are written once
    local = store(ranged.withColumn("_loc", F.row_number().over(w)))
    counts = local.groupBy("_pid", *by).agg(F.max("_loc").alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *by, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_pid", *by])
                 .withColumn("occ", (F.col("_off") + F.col("_loc")).cast("int"))
                 .drop("_pid", "_loc", "_off"))


def pair_documents(src_keys: DataFrame, tgt_keys: DataFrame, parity: bool = False,
                   carry: list[str] | None = None) -> DataFrame:
    """Pair the i-th source with the i-th target transaction of each value.

    Occurrence order is (doc_id, tx_index) – deterministic, unlike directory
    listing order (T6) – and numbering is skew-safe (``occurrence_numbers``).  Both sides are
    numbered in one partitioning by value, in which an aggregation on (value, occurrence) then
    pairs them.  All surplus transactions are kept (T5);
    ``parity=True`` drops target surplus of values the source has, as the
    original tool does.
    Output: pair_id, match_value, occ, source_file, source_tx, target_file, target_tx, and the
    columns of the keys named in ``carry`` as source_<name>, target_<name>.
    """
    carry = carry or []
    columns = ["match_value", "doc_id", "tx_index", *carry]
    keys = src_keys.select(*columns, F.lit(True).alias("_source")).unionByName(
        tgt_keys.select(*columns, F.lit(False).alias("_source")))
    own = {"source": F.col("_source"), "target": ~F.col("_source")}
    pairs = (occurrence_numbers(keys, "match_value", ["doc_id", "tx_index"], ["_source"])
             .groupBy("match_value", "occ")
             .agg(*[F.max(F.when(mine, F.col(c))).alias(f"{side}_{name}")
                    for side, mine in own.items() for c, name in (("doc_id", "file"), ("tx_index", "tx"), *zip(carry, carry))]))
    if parity:
        src_values = src_keys.select("match_value").distinct()
        surplus = pairs.filter(F.col("source_file").isNull()).join(src_values, "match_value", "left_semi")
        pairs = pairs.join(surplus.select("match_value", "occ"), ["match_value", "occ"], "left_anti")
    pair_id = F.concat_ws("#", F.col("match_value"), F.col("occ").cast("string"))
    return pairs.select(pair_id.alias("pair_id"), "match_value", "occ", "source_file", "source_tx",
                        "target_file", "target_tx", *[f"{side}_{c}" for c in carry for side in own])


# ------------------------------------------------------------------ record alignment

def _packed(names: Column, values: Column) -> Column:
    """``str(dict)`` of a packed record: ``{'a': '1', 'b': '2'}`` in field order."""
    items = F.zip_with(names, unpack(values), lambda n, v: F.concat(F.lit("'"), n, F.lit("': '"), v, F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def x12_qualified(segments: DataFrame, qualifiers: dict[str, str | None], by: Sequence[str] = ("doc_id", "tx_index")) -> DataFrame:
    """C7/C8/J8 keys: qualifier value and occurrence inside (segment, qualifier) of a transaction,
    which ``by`` names.

    Segments whose id has a qualifier field align by that field's value, the
    rest by position.  The label is ``SEG*qual`` / ``SEG`` / ``SEG*position_i``
    (F20).  The qualifier table is configuration, merged on the driver.  The label and the
    names of the fields follow from the key, so they are made after the join (``x12_kind``).
    """
    qual_idx = F.lit(None).cast("int")
    for seg, qf in sorted(qualifiers.items()):
        if qf:
            qual_idx = F.when(F.col("segment") == seg, F.lit(x12_field_index(qf))).otherwise(qual_idx)
    has_q = qual_idx.isNotNull()
    qv = F.coalesce(F.get(F.col("elements"), qual_idx), F.lit(""))
    s = segments.select(
        *by, "seg_pos", F.col("segment").alias("seg"), F.when(has_q, qv).alias("qual"),
        pack(F.slice(F.col("elements"), 2, F.greatest(F.size("elements") - 1, F.lit(0)))).alias("values"))
    w = Window.partitionBy(*by, "seg", "qual").orderBy("seg_pos")
    return s.select(*by, "seg", F.coalesce(F.col("qual"), F.lit("")).alias("qual"),
                    (F.row_number().over(w) - 1).alias("occ"), F.lit(None).cast("string").alias("names"), "values")


def flat_packed(records: DataFrame) -> DataFrame:
    """Flat records with their fields packed (packed ones as they are); a ``pair_id`` stays."""
    if "fields" not in records.columns:
        return records
    return records.select(*[c for c in records.columns if c != "fields"], pack(F.col("fields.field")).alias("names"),
                          pack(F.col("fields.value")).alias("values"))


@dataclass(frozen=True)
class Kind:
    """What the records of a kind of document align by within their transaction, and what follows
    from that key: section, segment, label, and the names of the fields."""

    key: list[str]
    section: Column
    seg: Column
    label: Column
    names: Callable[[Column, Column], Column]


def flat_kind() -> Kind:
    """Labels of flat records: header / line_<i> / summary / flat."""
    label = (F.when(F.col("section") == "line", F.concat(F.lit("line_"), F.col("occ").cast("string")))
              .otherwise(F.col("section")))
    return Kind(["section", "occ"], F.col("section"), F.col("section"), label, lambda packed, values: unpack(packed))


def x12_kind(qualifiers: dict[str, str | None]) -> Kind:
    """``SEG*qual`` / ``SEG`` / ``SEG*position_i`` (F20); fields are numbered."""
    has_q = F.col("seg").isin([seg for seg, qf in sorted(qualifiers.items()) if qf])
    label = (F.when(~has_q, F.concat(F.col("seg"), F.lit("*position_"), F.col("occ").cast("string")))
              .when(F.col("qual") != "", F.concat(F.col("seg"), F.lit("*"), F.col("qual")))
              .otherwise(F.col("seg")))
    return Kind(["seg", "qual", "occ"], F.lit("x12"), F.col("seg"), label, lambda packed, values: F.transform(
        values, lambda v, i: F.concat(F.col("seg"), F.lpad((i + 1).cast("string"), 2, "0"))))


def cq_fields(book: R.RuleBook, crosswalk: list[dict] | None) -> list[str]:
    return sorted({r["conditional_qualifier"] for r in book.rows(crosswalk) if r["conditional_qualifier"]})


def _presence_description(label: Column, only_src: Column) -> Column:
    return (F.when(F.col("section") == "x12",
                   F.when(only_src, F.concat(F.lit("Missing segment in Target: "), label))
                    .otherwise(F.concat(F.lit("Extra segment in Target: "), label)))
             .otherwise(F.when(only_src, F.concat(F.lit("Missing line in Target at position "), F.col("occ").cast("string")))
                         .otherwise(F.concat(F.lit("Extra line in Target at position "), F.col("occ").cast("string")))))


def _unequal(joined: DataFrame) -> DataFrame:
    """Joined records without those that are equal on both sides."""
    return joined.where(~(F.col("_sv").eqNullSafe(F.col("_tv")) & F.col("_sn").eqNullSafe(F.col("_tn"))))


def _meet(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records of both sides (``source`` says which) that are partitioned by ``place`` already: their
    full outer join on ``keys`` as a window within the place, so none is moved.  A key occurs a few
    times a side at most; each source record then meets each target record, as in a join."""
    w = Window.partitionBy("place", *keys).orderBy("source")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    record = F.struct("names", "values")
    met = records.select("place", *keys, F.row_number().over(w).alias("_r"),
                         F.collect_list(F.when(F.col("source"), record)).over(every).alias("_s"),
                         F.collect_list(F.when(~F.col("source"), record)).over(every).alias("_t")).where("_r = 1")
    return (met.where(~((F.size("_s") == 1) & (F.size("_t") == 1) & F.get("_s", F.lit(0)).eqNullSafe(F.get("_t", F.lit(0)))))
               .select(*keys, F.explode_outer("_s").alias("_s"), "_t").select(*keys, "_s", F.explode_outer("_t").alias("_t"))
               .select(*keys, *[F.col(f"_{p}.{c}").alias(f"_{p}{c[0]}") for p in "st" for c in ("names", "values")]))


def placed(pairs: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rows of both sides (doc_id, tx_index and others) that belong to complete pairs, with their
    ``pair_id`` and ``source`` (whether they are the source's), partitioned by ``place``, a hash of the
    pair's source transaction.  Source rows move once, target rows to their pair and then there; the
    rows of a place learn their pair from its own row, so neither side is joined with the other."""
    both = pairs.filter(F.col("source_file").isNotNull() & F.col("target_file").isNotNull()).select(
        "pair_id", F.col("source_file").alias("_file"), F.col("source_tx").alias("_tx"),
        F.col("target_file").alias("doc_id"), F.col("target_tx").alias("tx_index"))
    others = [c for c in src.columns if c not in ("doc_id", "tx_index")]
    none = [F.lit(None).cast(src.schema[c].dataType).alias(c) for c in others]
    rows = (src.select(F.col("doc_id").alias("_file"), F.col("tx_index").alias("_tx"), F.lit(None).cast("string").alias("_pair"),
                       F.lit(True).alias("source"), *others)
            .unionByName(tgt.join(both, ["doc_id", "tx_index"]).select("_file", "_tx", F.col("pair_id").alias("_pair"),
                                                                       F.lit(False).alias("source"), *others))
            .unionByName(both.select("_file", "_tx", F.col("pair_id").alias("_pair"), F.lit(None).cast("boolean").alias("source"), *none)))
    at = rows.withColumn("place", F.xxhash64("_file", "_tx")).repartition("place")
    pair = F.max("_pair").over(Window.partitionBy("place", "_file", "_tx"))
    return at.withColumn("pair_id", pair).where("pair_id is not null and source is not null").select(
        "place", "pair_id", "source", *others)


def align(pairs: DataFrame, src: DataFrame | None, tgt: DataFrame | None, kind: Kind, cqs: list[str],
          in_place: Sequence[DataFrame] = ()) -> DataFrame:
    """Align packed records of both sides in one pass.

    ``src``/``tgt``: doc_id, tx_index, the key of ``kind``, names, values.  Records of documents that
    know their pair have it as ``pair_id`` (null: no complete pair, not compared) and move once, to
    a full outer join at record grain; others learn it where they meet (:func:`placed`).
    ``in_place``: records of both sides (``source`` says which) with their pair, partitioned by
    ``place``, where all records of a pair are; they meet there and do not move (``_meet``).  Where
    no others are, ``src`` and ``tgt`` are None.
    Every output row is either

    * a presence row (``presence`` true): a line or segment present on one side
      only – one hard diff with field '' and the record as text; or
    * a candidate field of a record present on both sides whose text differs
      (equal text is never a diff under any rule, so it is dropped here).

    Presence rows carry a NULL ``rule_segment`` so the ignore and rule joins
    pass them through untouched.  The values of conditional-qualifier fields
    ``cqs`` ride along per row (``_scq{i}``/``_tcq{i}``).  The rows are stored, so that runs
    under several rule books can read them.
    """
    paired = src is None or ("pair_id" in src.columns and "pair_id" in tgt.columns)
    if in_place and not paired:
        raise ValueError("beside records in place, others know their pair")
    if not paired:
        in_place, src = [placed(pairs, src, tgt)], None
    at = ["pair_id", *kind.key]
    s_cols, t_cols = ([F.col("names").alias(f"_{p}n"), F.col("values").alias(f"_{p}v")] for p in "st")
    s, t = (None, None) if src is None else (side.where("pair_id is not null").select(*at, *cols) for side, cols in ((src, s_cols), (tgt, t_cols)))
    joined = [_meet(part, at) for part in in_place] + ([] if s is None else [s.join(t, at, "full_outer")])
    j = reduce(DataFrame.unionByName, map(_unequal, joined))
    presence_kind = kind.section.isin("line", "x12")
    only_src = F.col("_tv").isNull() & presence_kind
    only_tgt = F.col("_sv").isNull() & presence_kind
    j = j.select(*at, (only_src | only_tgt).alias("presence"), only_src.alias("only_src"),
                 F.coalesce("_sn", "_tn").alias("_names"), "_sn", "_tn", "_sv", "_tv",
                 *[unpack(F.coalesce(F.col(f"_{p}v"), F.lit(""))).alias(f"_{p}a") for p in "st"])
    j = j.withColumns({f"_{p}f": F.zip_with(
        F.coalesce(kind.names(F.col(f"_{p}n"), F.col(f"_{p}a")), F.array().cast("array<string>")), F.col(f"_{p}a"),
        lambda n, v: F.struct(n.alias("field"), v.alias("value"))) for p in "st"})
    j = j.withColumns({f"{p}m": fields_map(F.col(f"_{p}f")) for p in "st"})
    presence_row = F.array(F.struct(F.lit("").alias("key"), F.struct(F.col("_sv").alias("s"),
                                                                       F.col("_tv").alias("t")).alias("value")))
    field_rows = F.map_entries(F.map_zip_with("sm", "tm", lambda k, a, b: F.struct(a.alias("s"), b.alias("t"))))
    rows = F.when(F.col("presence"), presence_row).otherwise(
        F.filter(field_rows, lambda e: F.coalesce(e["value"]["s"], F.lit("")) != F.coalesce(e["value"]["t"], F.lit(""))))
    cq_cols = []
    for i, q in enumerate(cqs):
        cq_cols += [F.element_at("sm", F.lit(q)).alias(f"_scq{i}"), F.element_at("tm", F.lit(q)).alias(f"_tcq{i}")]
    ex = j.select(*at, "presence", "only_src", F.when(F.col("presence"), F.col("_names")).alias("_names"),
                  *cq_cols, F.explode(rows).alias("e"))
    rows = store(ex.select(*[c for c in ex.columns if c != "e"], F.col("e.key").alias("field"),
                           F.col("e.value.s").alias("s"), F.col("e.value.t").alias("t")))
    rule_seg = F.when(F.col("presence"), F.lit(None).cast("string")) \
                .when(kind.section == "x12", kind.seg).otherwise(F.lit("*"))

    def text(c: str) -> Column:
        record = F.col(c)
        return F.when(F.col("presence") & record.isNotNull(), _packed(kind.names(F.col("_names"), unpack(record)), record)).when(
            ~F.col("presence"), record)

    return rows.select("pair_id", kind.section.alias("section"), "occ", kind.label.alias("label"), "presence", "only_src", "field",
                       *[c for i in range(len(cqs)) for c in (f"_scq{i}", f"_tcq{i}")],
                       rule_seg.alias("rule_segment"), text("s").alias("s"), text("t").alias("t"))


def diff_aligned(spark: SparkSession, cand: DataFrame, cqs: list[str], book: R.RuleBook,
                 crosswalk: list[dict] | None = None) -> DataFrame:
    """Diffs of aligned rows (C9–C15): the ignore list (broadcast anti joins), rule
    resolution (broadcast joins) and evaluation – one linear plan.  ``cqs``: the fields
    that the rows were aligned with, among them the book's."""
    cand = R.drop_ignored(cand, R.ignores_frame(spark, book), n_rules=len(book.ignored))
    merged = R.merge_config(book, crosswalk)
    star = next((m for m in merged if m["segment"] == "*" and m["field"] == "*"), None)
    cand = R.resolve(cand, R.merged_frame(spark, book, crosswalk), star_rule=star,
                     n_rules=len(merged))
    return evaluate(cand, cqs)


def evaluate(cand: DataFrame, cqs: list[str]) -> DataFrame:
    """Decide and describe each aligned row."""
    cand = cand.withColumns({"_ds": as_double(F.coalesce("s", F.lit(""))),
                             "_dt": as_double(F.coalesce("t", F.lit("")))})
    sp, tp = F.col("s").isNotNull(), F.col("t").isNotNull()
    s, t = F.coalesce("s", F.lit("")), F.coalesce("t", F.lit(""))
    ds, dt = F.col("_ds"), F.col("_dt")
    # tolerance only for flat documents, as the original X12 path ignores it
    variance = F.when(F.col("section") != "x12", F.col("amount_variance"))
    num_eq = F.coalesce(
        F.col("numeric") & ~F.isnan(ds) & ~F.isnan(dt)
        & F.when(variance.isNull(), ds == dt).otherwise(F.abs(F.round(ds - dt, 9)) <= variance),
        F.lit(False))
    text_eq = F.when(F.col("ignore_case"), F.lower(s) == F.lower(t)).otherwise(s == t)
    s_cq, t_cq = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, q in enumerate(cqs):
        s_cq = F.when(F.col("conditional_qualifier") == q, F.col(f"_scq{i}")).otherwise(s_cq)
        t_cq = F.when(F.col("conditional_qualifier") == q, F.col(f"_tcq{i}")).otherwise(t_cq)
    cq_ok = F.col("conditional_qualifier").isNotNull() & (
        (~sp & F.coalesce(s_cq != "", F.lit(False))) | (~tp & F.coalesce(t_cq != "", F.lit(False))))
    is_diff = F.col("presence") | (~num_eq & ~text_eq & (F.col("severity") != "ignore") & ~cq_ok)
    noun = F.when(F.col("section") == "x12", F.lit("field")).otherwise(F.lit("key"))
    desc = (F.when(F.col("presence"), _presence_description(F.col("label"), F.col("only_src")))
             .when(~sp, F.concat(F.lit("Missing "), noun, F.lit(" in Source: "), F.col("field"),
                                 F.lit(" (Target has: '"), t, F.lit("')")))
             .when(~tp, F.concat(F.lit("Missing "), noun, F.lit(" in Target: "), F.col("field"),
                                 F.lit(" (Source has: '"), s, F.lit("')")))
             .otherwise(F.concat(F.lit("Content mismatch: Source='"), s, F.lit("' vs Target='"), t, F.lit("'"))))
    pres = F.col("presence")
    return cand.filter(is_diff).select(
        "pair_id", F.col("label").alias("segment"), "field",
        F.when(pres, F.lit("hard")).otherwise(F.col("severity")).alias("severity"),
        F.when(pres, F.col("s")).when(sp, s).alias("source_value"),
        F.when(pres, F.col("t")).when(tp, t).alias("target_value"),
        desc.alias("description"), F.when(pres, F.lit(False)).otherwise(F.col("wildcard")).alias("wildcard"))


def align_flat(pairs: DataFrame, src_records: DataFrame | None, tgt_records: DataFrame | None, cqs: list[str],
               in_place: Sequence[DataFrame] = ()) -> DataFrame:
    """Aligned rows of flat documents (header, lines by position, summary), for any rules that
    take conditional qualifiers from ``cqs``.  ``in_place``: see :func:`align`."""
    src, tgt = (None if side is None else flat_packed(side) for side in (src_records, tgt_records))
    return align(pairs, src, tgt, flat_kind(), cqs, [*map(flat_packed, in_place)])


def diff_flat(spark: SparkSession, pairs: DataFrame, src_records: DataFrame, tgt_records: DataFrame,
              book: R.RuleBook, crosswalk: list[dict] | None = None) -> DataFrame:
    """Diffs of flat documents (header, lines by position, summary)."""
    cqs = cq_fields(book, crosswalk)
    return diff_aligned(spark, align_flat(pairs, src_records, tgt_records, cqs), cqs, book, crosswalk)


def diff_x12(spark: SparkSession, pairs: DataFrame, src_segments: DataFrame, tgt_segments: DataFrame,
             book: R.RuleBook, qualifiers: dict[str, str | None],
             crosswalk: list[dict] | None = None) -> DataFrame:
    """Diffs of X12 transactions, segments aligned by qualifier.

    Transactions of a row each (``sources.x12.whole_transactions``) move whole, and their segments
    are numbered and meet where they are; segments of any other size move one by one."""
    cqs = cq_fields(book, crosswalk)
    if "pieces" in src_segments.columns:
        there = segments_of(placed(pairs, src_segments, tgt_segments))
        records = [x12_qualified(there, qualifiers, ("place", "pair_id", "source"))]
        cand = align(pairs, None, None, x12_kind(qualifiers), cqs, records)
    else:
        cand = align(pairs, x12_qualified(src_segments, qualifiers), x12_qualified(tgt_segments, qualifiers),
                     x12_kind(qualifiers), cqs)
    return diff_aligned(spark, cand, cqs, book, crosswalk)


# ------------------------------------------------------------------ statuses and totals

def pair_status(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Status and diff count per pair.  Diff counts are aggregated
    before the join so the join is at pair grain."""
    counts = diffs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("diff_count"))
    p = pairs.join(counts, "pair_id", "left")
    n = F.coalesce("diff_count", F.lit(0)).cast("bigint")
    status = (F.when(F.col("source_file").isNull() | F.col("target_file").isNull(), F.lit("UNMATCHED"))
               .when(n > 0, F.lit("MISMATCH")).otherwise(F.lit("MATCH")))
    return p.select(*pairs.columns, status.alias("status"),
                    F.when(status == "UNMATCHED", F.lit(0).cast("bigint")).otherwise(n).alias("diff_count"))


def run_summary(statuses: DataFrame) -> DataFrame:
    """Totals of a run."""
    return statuses.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(F.col("status") == "MATCH").alias("matched"),
        F.count_if(F.col("status") == "MISMATCH").alias("mismatched"),
        F.count_if(F.col("status") == "UNMATCHED").alias("unmatched"),
        F.count_if(F.col("source_file").isNull()).alias("target_only"),
        F.count_if(F.col("target_file").isNull()).alias("source_only"),
        F.coalesce(F.sum("diff_count"), F.lit(0)).cast("bigint").alias("total_diffs"))
