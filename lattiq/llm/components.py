"""Connected components of a distributed link table, by alternating star contraction.

Large-star and small-star steps rewrite the links until every node points at its
component's smallest node.  Each step is a map-side-combined minimum and one
join, both on the node; rows never outnumber twice the links.  State is written to the
shared folder between rounds, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import cut


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (a, b), a > b.  Large: larger neighbours join the smallest one.  Small: the others do."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    moved = joined.select(F.col("b").alias("x"), "m") if small else joined.where("b > a").select(F.col("b").alias("x"), "m")
    if small:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; any order, loops and repeats allowed) but the smallest ones.

    ``component`` is the smallest node reachable.  An empty table of links gives no rows.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        now = cut(_star(_star(now, small=False), small=True))
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
