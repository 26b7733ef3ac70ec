"""Connected components of a table of links, by star contraction: every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import written


def _joined_to_least(links: DataFrame) -> DataFrame:
    """``(u, v)`` with the least neighbour ``m`` of u. The least is pre-aggregated, and Spark may split a hot u."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _joined_to_least(both).filter(F.col("v") > F.col("u"))
    return least.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _joined_to_least(down)
    moved = least.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, component)`` for every node but the smallest of its component; ``links`` has long ``u`` and ``v``.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of the
    longest path. Only a count and a checksum come to the driver.
    """
    links = written(links.filter(F.col("u") != F.col("v")), "links")
    seen = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select("u", F.col("v").alias("component"))
        seen = state
