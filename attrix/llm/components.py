"""Connected components of links by alternating star contractions.

Every round hangs the larger neighbours of a node on its smallest one (large
star), then its smaller neighbours and itself (small star).  Each round is two
grouped minima with partial aggregation and a join, written to the shared
checkpoint folder; it ends when a round changes nothing, after about
log2(longest path) rounds.  Nothing but one count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hung(arrows: DataFrame, least: DataFrame) -> DataFrame:
    return arrows.join(least, "a").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")) \
        .where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return _hung(both.where("b > a"), low)


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    return _hung(links.select("a", "b"), low).union(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of a link
    ``a, b``; duplicates and self-links are allowed."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = links.checkpoint()
    before = None
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(links.select("b", F.col("b").alias("root")).distinct())
