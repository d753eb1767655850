"""Connected components of a table of links, by alternating large-star and small-star
steps.  Links stay in tables: nothing but two numbers a round goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import write_through


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger (or its smaller) neighbours, and itself, to
    the smallest of its neighbourhood.  Rows are (u, v), u > v."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of longs); the component
    is its smallest node.  Without links there are no rows."""
    a, b = links.columns
    links = write_through(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                          .where("u > v").distinct(), "links")
    before = None
    while True:
        links = write_through(_stars(_stars(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every node now points to the smallest one of its component
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
