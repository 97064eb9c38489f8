"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import discard, forget, salted_join, stored


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger (`upward`) or its smaller neighbours."""
    if upward:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = links.select(F.inline(ways))
    else:
        both = links.select(F.col("b").alias("a"), F.col("a").alias("b"))  # b is the larger end of a link
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = salted_join(both, least, ["a"], F.col("b"), "inner")
    if upward:
        out = near.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = near.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") < F.col("b")).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every larger end of the distinct links is that of one link only, and the smaller end of none."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("larger")), F.struct(F.col("b").alias("node"), F.lit(1).alias("larger")))
    nodes = links.select(F.inline(ends)).groupBy("node").agg(F.sum("larger").alias("larger"), F.count(F.lit(1)).alias("n"))
    return nodes.where("larger > 0 and n > 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); root is the smallest node of its component.

    The number of rounds grows with the logarithm of the nodes, and each round's links are written to the shared folder, where
    only the last round's stay (the caller may `discard` the result). Rounds end when all links are stars, so links that are
    stars from the start need none. Only a count comes to the driver. Links of a node to itself and repeated links don't matter.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    while not _all_stars(links):
        after = stored(_star(_star(links, True), False), "links")
        discard(links)
        links = after
        forget(links.sparkSession)
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots.stored_at = links.stored_at
    return roots
