"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) long edges that is not its component's smallest node itself.

    Each step is a table in the shared folder; hubs are pre-aggregated (min) and their edges joined, never gathered.
    """
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stored(directed, "cc")
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        after = _mark(small)
        discard(large)
        discard(current)
        current = small
        if after == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = after
