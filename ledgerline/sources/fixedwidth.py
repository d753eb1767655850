"""Fixed-width multi-record files.

A layout is ``{record_id: [(name, width, type, implied_decimals), ...]}``;
the first field of every record is the record id.  The id of a line is its
first ``max(width of the first field)`` characters (stripped).  Each field
is a ``substring`` at a plan-time offset, stripped; empty text becomes NULL
when ``empty_as_null``.  ``ImpliedDecimal`` fields keep their width (the
original drops them and shifts every later field, T3) and read
``int / 10^decimals`` as a decimal (NULL, like any text that is no number, when it has more
digits than a decimal holds; ``quality.conformance`` reports such values).  Lines with unknown ids are returned
separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import transforms as TF
from ledgerline.sources.delimited import lines


def _value(line, offset: int, width: int, typ: str, decimals: int, empty_as_null: bool):
    raw = TF.btrim_ws(F.substring(line, offset + 1, width))
    if empty_as_null:
        raw = F.when(raw != "", raw)
    if typ == "implied_decimal":
        # digits and an exponent, so no digit is lost and the text is matched once (of other text the
        # exponent is left, which is no number); more digits than a decimal holds are NULL
        digits = F.regexp_extract(raw, r"^([+-]?\d+)$", 1)
        return F.concat(digits, F.lit(f"E-{decimals}")).try_cast(f"decimal(38,{decimals})")
    if typ == "integer":
        return TF.to_int(raw)
    if typ == "float":
        return TF.to_float(raw)
    return raw


def read_fixed_width(files: DataFrame, layouts: dict[str, list[tuple]], empty_as_null: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns ``(records, unknown)``.

    ``records(path, line_no, record_id, fields)`` where ``fields`` is a struct
    per record type (NULL for other types), so every record type keeps its own
    typed columns in one scan; ``unknown(path, line_no, record_id)``.
    """
    id_width = max(spec[0][1] for spec in layouts.values())
    ln = lines(files)
    rid = TF.btrim_ws(F.substring("line", 1, id_width))
    r = ln.withColumn("record_id", rid)
    known = r.filter(F.col("record_id").isin(*layouts.keys()))
    cols = []
    for rec, spec in sorted(layouts.items()):
        off, fields = 0, []
        for f in spec:
            name, width, typ = f[0], f[1], f[2] if len(f) > 2 else "string"
            dec = f[3] if len(f) > 3 else 0
            fields.append(_value(F.col("line"), off, width, typ, dec, empty_as_null).alias(name))
            off += width
        cols.append(F.when(F.col("record_id") == rec, F.struct(*fields)).alias(rec))
    out = known.select("path", "line_no", "record_id", *cols)
    unknown = r.filter(~F.col("record_id").isin(*layouts.keys())).select("path", "line_no", "record_id")
    return out, unknown
