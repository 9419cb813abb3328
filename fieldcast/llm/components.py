"""Connected components by alternating large-star and small-star rounds, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node that can be reached.

    Each round keeps at most as many edges as before and cuts its lineage with a checkpoint; rounds grow with the
    logarithm of the longest chain.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        large = both.join(least, F.col("v") == F.col("w")).filter("u > v AND u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
        stars = large.join(lower, F.col("v") == F.col("w")).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s"))
        e = saved(stars.select("s.*").filter("v <> u").distinct())
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())
