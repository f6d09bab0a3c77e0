"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (id, comp): for each id with an edge, the smallest id of its component.

    Each round replaces the edges at every node by edges to its least neighbour (first for the greater, then for the
    lesser neighbours), which at least halves the depth; it ends when a round changes nothing. Only counts reach the
    driver. Self-loops and repeated edges are allowed; no edges give no rows."""
    e = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen or state["n"] == 0:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.cut(small.filter("u <> v").distinct())
        scratch.drop(e)
        e = after
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
