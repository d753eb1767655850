"""X12 interchanges as DataFrames.

Tokenising is native Spark: the element separator is character 4 of the ISA
segment and the segment terminator character 106; ``split`` with that
character, drop blank pieces, strip cosmetic CR/LF, ``posexplode`` for the
segment position and ``split`` again for the elements.  Segment ids are
element 0 and fields keep standard X12 numbering (``BIG02`` is element 2).

One row per file is right for interchanges up to a few hundred MB.  A single
multi-GB interchange is read with ``read_large`` instead: the text source
splits it at the terminator in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.carry import AT, Fold, in_order, running
from ledgerline.functions.packing import pack, unpack
from ledgerline.functions.transforms import WHITESPACE
from ledgerline.session import store

ISA_LENGTH = 106


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _quoted(c):
    """The character as a pattern; Java splits by an escaped one without compiling a pattern."""
    return F.when((c != "") & (F.instr(F.lit(_PUNCTUATION), c) > 0), F.concat(F.lit("\\"), c)).otherwise(
        F.concat(F.lit("\\Q"), c, F.lit("\\E")))


def _pieces(files: DataFrame, path_col: str, content_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _sep, _cut, _pieces) of interchanges, and the files that are none."""
    c = F.col(content_col)
    valid = (F.length(c) >= ISA_LENGTH) & c.startswith("ISA")
    f = files.select(F.col(path_col).alias("doc_id"), c.alias("content"), valid.alias("_ok"))
    errors = f.filter(~F.coalesce("_ok", F.lit(False))).select(
        "doc_id", F.lit("TRANSFORMATION").alias("stage"),
        F.lit("PARSE_FAIL: not an X12 interchange (missing ISA header)").alias("reason"))
    sep, term = F.substring("content", 4, 1), F.substring("content", ISA_LENGTH, 1)
    # newline as terminator keeps newlines; otherwise CR/LF around segments are cosmetic
    pieces = F.split(F.col("content"), _quoted(term), -1)
    pieces = F.filter(pieces, lambda s: F.btrim(s, F.lit(WHITESPACE)) != "")
    pieces = F.transform(pieces, lambda s: F.btrim(s, F.lit("\r\n")))
    return f.filter(F.col("_ok")).select("doc_id", sep.alias("_sep"), _quoted(sep).alias("_cut"), pieces.alias("_pieces")), errors


def parse(files: DataFrame, path_col: str = "doc_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Tokenise interchanges.

    Returns ``(segments, errors)``: ``segments(doc_id, seg_pos, segment,
    elements)`` with ``elements[0]`` the segment id, and ``errors(doc_id,
    stage, reason)`` for content that is not an interchange (PARSE_FAIL).
    """
    pieces, errors = _pieces(files, path_col, content_col)
    segs = pieces.select("doc_id", "_cut", F.posexplode("_pieces").alias("seg_pos", "_raw"))
    elements = F.split(F.col("_raw"), F.col("_cut"), -1)
    return segs.select("doc_id", "seg_pos", elements[0].alias("segment"), elements.alias("elements")), errors


def _loops(files: DataFrame, path_col: str, content_col: str) -> tuple[DataFrame, DataFrame]:
    """The ST…SE loops of files of a row each, a row for each: ``doc_id``, ``tx_index``, ``cut`` (pattern
    between elements), ``first`` (position of the ST) and ``pieces`` (its segments' texts); and errors.

    They are found in the row, from the places of the file's ST and SE segments (an ST
    whose next such segment is an SE), so nothing is shuffled or sorted."""
    pieces, errors = _pieces(files, path_col, content_col)
    sep = F.col("_sep")

    def is_segment(piece: Column, name: str) -> Column:
        return (piece == name) | piece.startswith(F.concat(F.lit(name), sep))

    places = F.transform("_pieces", lambda s, i: F.when(s.startswith("S"), F.when(
        is_segment(s, "ST"), F.struct(i.alias("at"), F.lit(True).alias("st"))).when(
        is_segment(s, "SE"), F.struct(i.alias("at"), F.lit(False).alias("st")))))
    marked = pieces.withColumn("_marks", F.filter(places, lambda m: m.isNotNull()))
    following = F.transform("_marks", lambda m, i: F.struct(
        m["at"].alias("first"), m["st"].alias("st"), F.get("_marks", i + 1).alias("next")))
    loops = F.filter(following, lambda m: m["st"] & ~m["next"]["st"])
    tx = marked.select("doc_id", "_cut", "_pieces", F.posexplode(loops).alias("tx_index", "_loop"))
    first = F.col("_loop.first")
    return tx.select("doc_id", "tx_index", F.col("_cut").alias("cut"), first.alias("first"),
                     F.slice("_pieces", first + 1, F.col("_loop.next.at") - first + 1).alias("pieces")), errors


def _segments(loops: DataFrame) -> DataFrame:
    """Each segment of loops, with the loop's other columns."""
    own = [c for c in loops.columns if c not in ("cut", "first", "pieces")]
    segs = loops.select(*own, "cut", "first", F.posexplode("pieces").alias("_i", "_raw"))
    elements = F.split(F.col("_raw"), F.col("cut"), -1)
    return segs.select(*own, (F.col("first") + F.col("_i")).alias("seg_pos"), elements[0].alias("segment"), elements.alias("elements"))


def parse_transactions(files: DataFrame, path_col: str = "doc_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """S11 and S13 in one pass over files of a row each: ``(segments, errors)`` like
    :func:`parse`, but of the ST…SE loops only and with ``tx_index``; see :func:`_loops`."""
    loops, errors = _loops(files, path_col, content_col)
    return _segments(loops), errors


def whole_transactions(files: DataFrame, path_col: str = "doc_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """:func:`parse_transactions` with a row for each transaction, which names and numbers it once for
    all its segments (``pieces``, packed); :func:`segments_of` has them.  For files of a row each, whose
    transactions fit a row too."""
    loops, errors = _loops(files, path_col, content_col)
    return loops.withColumn("pieces", pack(F.col("pieces"))), errors


def segments_of(whole: DataFrame) -> DataFrame:
    """The segments of :func:`whole_transactions`, with the other columns that these have."""
    return _segments(whole.withColumn("pieces", unpack(F.col("pieces"))))


def read_large(spark: SparkSession, path: str, terminator: str, element_sep: str) -> DataFrame:
    """S11 for very large interchanges: the text reader splits a file at the segment
    terminator over many tasks, and segments are numbered by counts carried from task to
    task, so no task holds a whole file.  ``_at`` keeps the order for :func:`transactions_of_large`."""
    raw = (spark.read.option("lineSep", terminator).text(path)
                .select(F.col("_metadata.file_path").alias("doc_id"),
                        F.col("_metadata.file_block_start").alias("_blk"),
                        F.monotonically_increasing_id().alias("_mid"),
                        F.btrim(F.col("value"), F.lit("\r\n")).alias("_raw"))
                .filter(F.btrim("_raw", F.lit(WHITESPACE)) != ""))
    elements = F.split(F.col("_raw"), "\\Q" + element_sep + "\\E", -1)
    rows = raw.select("doc_id", "_blk", "_mid", elements[0].alias("segment"), elements.alias("elements"))
    placed = in_order(rows, "doc_id", "_blk", "_mid", keep=["doc_id", "segment", "elements"])
    return running(placed, ["doc_id"], n=Fold("count")).select("doc_id", (F.col("n") - 1).alias("seg_pos"), "segment", "elements", AT)


def sts() -> Fold:
    """The number of STs up to a segment."""
    return Fold("count", F.col("segment") == "ST")


def transactions_of_large(segments: DataFrame) -> DataFrame:
    """S13/W2 for files of any size: the loops of :func:`transactions`, without a window by file.

    ``segments`` have :data:`AT` (of :func:`read_large`, or ``carry.in_order`` by file and
    position).  Segments are grouped by the number of STs so far, a running count over tasks;
    a group closes with its first SE; closed groups, one row each, are numbered the same way.
    Rows that went through :func:`running` with ``_st=sts()`` before are not counted again."""
    numbered = segments if "_st" in segments.columns else running(segments, ["doc_id"], _st=sts())
    numbered = store(numbered)  # read for the ends of the groups, then for their segments
    closed = (numbered.where("_st > 0 and segment = 'SE'").groupBy("doc_id", "_st")
              .agg(F.min(AT).alias("_end")))
    placed = in_order(closed, "doc_id", "_st")
    loops = running(placed, ["doc_id"], _n=Fold("count")).select("doc_id", "_st", "_end", (F.col("_n") - 1).alias("tx_index"))
    # both sides hold one transaction's rows under a key; Spark splits a transaction that is too large
    return (numbered.join(loops, ["doc_id", "_st"]).where(F.col(AT) <= F.col("_end"))
            .select("doc_id", "tx_index", "seg_pos", "segment", "elements"))


def transactions(segments: DataFrame) -> DataFrame:
    """Keep ST…SE loops and number them per file, for files of up to some hundred MB
    (larger ones: :func:`transactions_of_large`; files of a row each: :func:`parse_transactions`).

    A new ST restarts the loop; an ST without SE is dropped, as are segments outside any
    loop (the envelope)."""
    upto = Window.partitionBy("doc_id").orderBy("seg_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("doc_id", "_st")
    is_se = F.col("segment") == "SE"
    s = segments.withColumn("_st", F.count_if(F.col("segment") == "ST").over(upto))
    s = s.withColumn("_end", F.min(F.when(is_se, F.col("seg_pos"))).over(group))
    kept = s.filter((F.col("_st") > 0) & (F.col("seg_pos") <= F.col("_end")))
    tx = F.count_if(is_se).over(upto) - is_se.cast("int")
    return kept.select("doc_id", tx.cast("int").alias("tx_index"), "seg_pos", "segment", "elements")


def transaction_types(tx_segments: DataFrame) -> DataFrame:
    """Transaction set id (ST01) per transaction."""
    return (tx_segments.filter(F.col("segment") == "ST")
                       .select("doc_id", "tx_index", F.get(F.col("elements"), 1).alias("transaction_type")))


def segment_profile(segments: DataFrame) -> DataFrame:
    """Segments per (file, segment id) with first position."""
    return (segments.groupBy("doc_id", "segment")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("seg_pos").alias("first_pos")))


def cardinality_violations(spark: SparkSession, tx_segments: DataFrame,
                           spec: list[tuple[str, int, int | None]]) -> DataFrame:
    """Required segments and maximum use per transaction.

    ``spec`` is configuration – ``(segment, min_use, max_use)`` of a standard's
    segment list.  The segments that it names are counted in one aggregation, a row for each
    transaction (combined before the shuffle), and the row's violations are exploded.
    """
    names = sorted({seg for seg, _, _ in spec})
    counts = tx_segments.groupBy("doc_id", "tx_index").agg(
        *[F.count_if(F.col("segment") == seg).alias(f"_n{i}") for i, seg in enumerate(names)])
    n = {seg: F.col(f"_n{i}") for i, seg in enumerate(names)}

    def violation(seg: str, violated: Column, count: Column, name: str) -> Column:
        return F.when(violated, F.struct(F.lit(seg).alias("segment"), count.alias("n"), F.lit(name).alias("violation")))

    found = [violation(seg, n[seg] > hi, n[seg], "too_many") for seg, _, hi in spec if hi is not None]
    found += [violation(seg, n[seg] == 0, F.lit(0).cast("bigint"), "missing_required")
              for seg in sorted({seg for seg, lo, _ in spec if lo and lo > 0})]
    if not found:
        found = [violation("", F.lit(False), F.lit(0).cast("bigint"), "")]
    return (counts.select("doc_id", "tx_index", F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("_v"))
                  .select("doc_id", "tx_index", "_v.*"))
