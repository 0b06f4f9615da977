"""Connected components of links between numbered things, by star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm._shared import Scratch, discard, settled


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select("b", "a"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest one."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Links run from the larger to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components", scratch: Scratch | None = None) -> DataFrame:
    """links: columns a, b (long). Returns node, component: the smallest node that can be reached.

    Only nodes with a link to another come out. Every round writes a table, so a lost executor costs one round, and
    deletes the one before; the rounds grow with the logarithm of the longest path. Nothing but two sums a round reaches
    the driver. The last table goes when scratch is cleared, and stays without one.
    """
    now, path = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    seen = None
    while True:
        after, made = settled(_small_star(_large_star(now)), label)
        discard(links.sparkSession, path)
        now, path = after, made
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            if scratch:
                scratch.paths.append(path)
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = sums
