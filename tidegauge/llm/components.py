"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Rounds that no input of this size needs: each at least halves the longest chain.
MOST_ROUNDS = 100


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (u, v: long) but each component's smallest.

    Each round's links are checkpointed; only their count and checksum reach the driver.
    """
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    for _ in range(MOST_ROUNDS):
        e = kept(_small_star(_large_star(e)))
        now = e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
