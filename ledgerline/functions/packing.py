"""Arrays of text as one string, for rows that are shuffled, sorted or stored.

An array of short texts takes a multiple of its characters in Spark's row format (offsets,
lengths, padding to words), in memory and on disk.  ``pack`` writes each value and an end mark;
marks inside values are escaped, so ``unpack`` gives back any array, with its nulls, and two
arrays are equal exactly when their packed forms are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END, ESCAPE = "\x1f", "\x1b"
_NULL = ESCAPE + "N"


def pack(values: Column) -> Column:
    """``array<string>`` as a string; null stays null."""
    marked = F.array_join(values, "")
    escaped = F.transform(values, lambda v: F.replace(F.replace(v, F.lit(ESCAPE), F.lit(ESCAPE + "E")),
                                                      F.lit(END), F.lit(ESCAPE + "S")))
    joined = F.when(marked.contains(ESCAPE) | marked.contains(END), F.array_join(escaped, END, _NULL)).otherwise(
        F.array_join(values, END, _NULL))
    return F.when(F.size(values) > 0, F.concat(joined, F.lit(END))).when(values.isNotNull(), F.lit(""))


def unpack(packed: Column) -> Column:
    """The array that :func:`pack` was given."""
    parts = F.split(packed, END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    plain = F.transform(parts, lambda p: F.when(p != _NULL, F.replace(
        F.replace(p, F.lit(ESCAPE + "S"), F.lit(END)), F.lit(ESCAPE + "E"), F.lit(ESCAPE))))
    return F.when(packed.contains(ESCAPE), plain).otherwise(parts)
