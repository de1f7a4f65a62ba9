"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, release


def _minimum(edges: DataFrame) -> DataFrame:
    """u -> the smallest of itself and its neighbours; combines before its shuffle, so hubs are no burden."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.coalesce(F.sum((F.col("u") != F.col("v")).cast("int")), F.lit(0))).first()
    return tuple(r)


def components(spark: SparkSession, links: DataFrame, most: int = 40) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that is reachable, for every node with a link to another.

    Each step halves distances to the smallest node; the steps end when the set of edges stays the same.
    """
    edges = checkpoint(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = _signature(edges)
    for _ in range(most):
        if not known[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(_minimum(large), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_minimum(large).select("u", F.col("m").alias("v")))
        edges = checkpoint(spark, small.where("u <> v").distinct())
        now = _signature(edges)
        del both, large, small
        release(spark)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
