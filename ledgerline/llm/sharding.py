"""Sharding by extendible hashing (DataFrame functions only).

A row's hash is a string of bits, and a directory entry is a prefix of them.  A prefix
whose rows exceed the byte limit is split on its next bit; every other prefix is a
shard.  The directory is found from byte sums of hash cells, not by re-dealing rows:

* each round sums bytes by cell of ``step`` more bits and rolls the cells up to every
  shorter prefix, so the depth at which a cell's prefix first fits is known at once;
* only rows of cells that are still too large go to the next round.

Bits come from the MD5 of the key, 64 of them; below these, rows of one key (copies of
an id, null ids) are told apart by the MD5 of a running number, so a hot key splits too.
A single row over the limit is a shard of its own, marked ``oversized``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import write_through

#: Bits of the key's hash and of the hash that tells rows of one key apart.
KEY_BITS, ROW_BITS = 64, 64


def bits_of(text: Column) -> Column:
    """The first 64 bits of the MD5, as a string of 0 and 1."""
    half = [F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 2), 32, "0")
            for at in (1, 9)]
    return F.concat(*half)


def directory(sizes: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Entries (prefix, shard_bytes, shard_rows, oversized) of rows (bits, size).

    The empty table has an empty directory."""
    found, rest, depth = None, sizes, 0
    while True:
        to = min(depth + step, KEY_BITS + ROW_BITS)
        cells = (rest.groupBy(F.substring("bits", 1, to).alias("cell"))
                 .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
        cells = write_through(cells, "shard-cells")
        at = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(to))))
        at = at.withColumn("prefix", F.expr("substring(cell, 1, d)"))
        sums = at.groupBy("prefix").agg(F.sum("size").alias("bytes"), F.sum("n").alias("rows"))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.length("prefix") == KEY_BITS + ROW_BITS)
        # a shard is a prefix that fits and whose parent does not
        parent = sums.where(~fits).select(F.col("prefix").alias("up"))
        leaf = sums.where(fits).withColumn("up", F.expr("substring(prefix, 1, length(prefix) - 1)"))
        first = F.length("prefix") == depth  # reached in this round only if its parent did not fit
        leaf = (leaf.where(~first).join(parent, "up", "left_semi").select("prefix", "bytes", "rows")
                .unionByName(leaf.where(first).select("prefix", "bytes", "rows")))
        found = leaf if found is None else found.unionByName(leaf)
        large = sums.where(~fits & (F.length("prefix") == to)).select(F.col("prefix").alias("cell"))
        if large.isEmpty():
            break
        rest = rest.withColumn("cell", F.substring("bits", 1, to)).join(large, "cell", "left_semi").drop("cell")
        depth = to
    # the first bits of a later round's cells were no shards in the round before
    return found.select("prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"),
                        (F.col("bytes") > limit).alias("oversized"))


def assign_shards(df: DataFrame, key: str, size: Column, limit: int, step: int = 12) -> DataFrame:
    """(key, size, shard, depth, shard_bytes, shard_rows, oversized) for every row.

    ``shard`` is the hash prefix of the directory entry, the empty string while one shard
    holds all.  A null key counts as the empty string, a null size as 0; repeated rows are
    rows of their own; an empty table gives no rows.  Other columns take no part, so
    their names cannot clash."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    # the running number is fixed by writing the rows (hashes and sizes, not texts)
    rows = write_through(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    return (entered(rows, limit, step)
            .select("key", "size", F.col("prefix").alias("shard"), F.length("prefix").alias("depth"),
                    "shard_bytes", "shard_rows", "oversized"))


def entered(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Rows (key, size, row: a running number that is fixed) joined to their directory entry."""
    rows = rows.withColumn("bits", F.concat(bits_of(F.coalesce(F.col("key").cast("string"), F.lit(""))),
                                            bits_of(F.col("row").cast("string"))))
    entries = write_through(directory(rows.select("bits", "size"), limit, step), "shard-directory")
    depths = sorted(r.d for r in entries.groupBy(F.length("prefix").alias("d")).count().collect())  # at most 129
    return located(rows, entries, depths)


def located(rows: DataFrame, entries: DataFrame, depths: list[int], spread: int = 6) -> DataFrame:
    """Rows joined to their entry through directory slots: an entry that is up to ``spread``
    bits shorter than the level's depth fills a slot for each continuation.  Entries that
    are deeper (hot keys) form the next level."""
    if not depths:
        return rows.join(entries.withColumn("slot", F.lit("")), F.col("bits") == F.col("slot"))
    deep = max(d for d in depths if d <= depths[0] + spread)
    short = F.lit(deep) - F.length("prefix")
    fill = F.when(short > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2), F.greatest(short, F.lit(0))) - 1).cast("long")),
        lambda i: F.lpad(F.bin(i), short, "0"))).otherwise(F.array(F.lit("")))
    slots = (entries.where(F.length("prefix") <= deep)
             .withColumn("fill", F.explode(fill)).withColumn("slot", F.concat("prefix", "fill")).drop("fill"))
    here = rows.withColumn("slot", F.substring("bits", 1, deep) if deep else F.lit("")).join(slots, "slot")
    rest = [d for d in depths if d > deep]
    return here.unionByName(located(rows, entries.where(F.length("prefix") > deep), rest, spread)) if rest else here


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str) -> None:
    """Write ``df`` under ``path/shard=b<bits>/``, one task per shard.

    The shards are those of the directory: rows of one key, copies and null keys included,
    are dealt by their running number, so no key is gathered.  The rows are written once
    with that number, as computing them again may number them otherwise.

    Where ``df`` has a column ``shard``, the folders are named ``_shard=`` (with more
    underscores, if need be) and the column is written like any other.  An empty table is
    one shard, of no bits and no rows, so it reads back with its columns."""
    name = "shard"
    while name in [c.lower() for c in df.columns]:
        name = "_" + name
    rows = df.select(F.struct("*").alias("of"), F.col(key).alias("key"),
                     F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    rows = write_through(rows.withColumn("row", F.monotonically_increasing_id()), "shard-texts")
    known = entered(rows.select("key", "size", "row"), limit).select("row", F.concat(F.lit("b"), "prefix").alias("_entry"))
    if rows.isEmpty():
        rows.select("of.*").write.parquet(f"{path}/{name}=b")
        return
    (rows.select("row", "of").join(known, "row").select("of.*", F.col("_entry").alias(name))
     .repartition(name).write.partitionBy(name).parquet(path))
