"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientele.functions.staging import stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes of ``edges`` (``a``, ``b``) but the roots."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(seen) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        large = _large(edges).where("a <> b").distinct()
        edges = stage(_small(large).where("a <> b").distinct(), "links")
