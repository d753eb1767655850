"""Running values over ordered rows, when one group may hold most of a table.

A window over the group would put such a group into one task.  Here the rows are
range-partitioned by (group, order), so a long group spans several tasks; each task's share
is folded on its own; the few totals of shares are folded in order; and what a share starts
from is joined back.  At most one group crosses each border between two tasks, so that table
has fewer rows than there are tasks and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import store

#: Place of a row in the order of the whole table: task in the high bits, row in the low ones.
AT = "_at"
_PART = "_part"


@dataclass(frozen=True)
class Fold:
    """An associative fold of a column: ``count``, ``sum``, ``xor``, ``last`` (not null)."""

    kind: str
    column: Column | None = None

    def over(self, window: Window) -> Column:
        return self._aggregate(lambda c: F.last(c, ignorenulls=True)).over(window)

    def total(self) -> Column:
        return self._aggregate(lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(AT))))

    def _aggregate(self, last) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)) if self.column is None else F.count(F.when(self.column, 1))
        return {"sum": F.sum, "xor": F.bit_xor, "last": last}[self.kind](self.column)

    def of_totals(self, name: str, window: Window) -> Column:
        folds = {"count": F.sum, "sum": F.sum, "xor": F.bit_xor, "last": lambda c: F.last(c, ignorenulls=True)}
        return folds[self.kind](F.col(name)).over(window)

    def joined(self, before: Column, own: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(own, before)
        if self.kind == "xor":
            return F.coalesce(own, F.lit(0)).bitwiseXOR(F.coalesce(before, F.lit(0)))
        return F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))


def in_order(df: DataFrame, *order: Column | str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) written in the given order, with :data:`AT`."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return store(placed if keep is None else placed.select(*keep, AT))


def running(placed: DataFrame, group: list[str], **folds: Fold) -> DataFrame:
    """``placed`` (of :func:`in_order`, ordered by ``group`` first) with each fold over the
    rows of the group up to the own one.  Null is a group of its own; an empty table gives
    no rows."""
    rows = placed.withColumn(_PART, F.shiftright(AT, 33))
    upto = Window.partitionBy(_PART, *group).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_{n}": f.over(upto) for n, f in folds.items()})
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(_PART, *group).agg(*[f.total().alias(n) for n, f in folds.items()])
    carried = (totals.withColumns({f"_c_{n}": f.of_totals(n, before) for n, f in folds.items()}
                                  | {"_c_parts": F.count(F.lit(1)).over(before)})
               .where("_c_parts > 0")
               .select(F.col(_PART).alias("_c_part"), *[F.col(g).alias(f"_g_{g}") for g in group],
                       *[f"_c_{n}" for n in folds]))
    same = F.col(_PART) == F.col("_c_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (own.join(F.broadcast(carried), same, "left")
            .withColumns({n: f.joined(F.col(f"_c_{n}"), F.col(f"_{n}")) for n, f in folds.items()})
            .select(*placed.columns, *folds))
