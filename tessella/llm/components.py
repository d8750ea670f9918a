"""Connected components by alternating stars, in DataFrame operations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> one row (node, component) for each node of an edge; component: the least node reachable.

    Large and small stars alternate until nothing changes, about log n times. The least neighbours are written
    before they are joined back, so that the edges of a hub can be split over tasks at run time. Nothing but counts reaches the driver.
    """
    now = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.put(large)
        least2 = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = scratch.put(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        scratch.drop(now, least, large, least2)
        now = after
