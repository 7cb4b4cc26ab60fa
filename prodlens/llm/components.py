"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones, of all; small: the smaller ones and itself) with its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written first, so that the join has plain exchanges on both sides, of which Spark can split those of hot nodes.
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    seen = both.join(least, "u")
    if large:
        made = seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = scratch.keep(made.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    scratch.free(least)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each linked node u and the smallest node v of its component; the smallest itself has no row.

    Edges (a, b) may repeat, in either direction; loops are left out. Each step writes its edges, so that lineage stays short.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        wide = _star(now, scratch, True)
        scratch.free(now)
        now = _star(wide, scratch, False)
        scratch.free(wide)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now
