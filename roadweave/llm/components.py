"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import cut, release


#: Slices (at most 64) that a node's neighbours are dealt over, so that a hub's rows don't meet in one task.
SLICES = 32


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (u, v, m): m the smallest of u and its neighbours.

    One partial aggregate finds the minima and which slices of the neighbours a node has, as bits of a
    number; minima are told to those slices only, so a hub's rows stay dealt out.
    """
    sliced = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SLICES)).cast("int"))
    least = sliced.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.bit_or(F.expr("shiftleft(1L, s)")).alias("held"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.getbit("held", i) == 1)
    return sliced.join(least.select("u", "m", F.explode(held).alias("s")), ["u", "s"]).drop("s")


def _settled(edges: DataFrame) -> bool:
    """Whether each node stands under one other at most, and under none if others stand under it: what the rounds end at."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("v", F.lit(0), F.lit(1)))
    left = ends.groupBy("n").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or (above = 1 and below = 1)")
    return not left.agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links (u, v) long -> (node, component): each linked node and the smallest node that it reaches.

    Rounds end when the links are stars, after O(log n) of them (none, if they come as such); each is written to the shared
    folder, where the one before it is then removed. Nulls and self-links are dropped; an empty table gives no rows.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        last, edges = edges, cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        release(last)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    out._table = edges._table
    return out
