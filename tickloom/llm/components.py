"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored


def _stars(links: DataFrame) -> DataFrame:
    """Both star steps on links with a > b; the components stay the same and links move to smaller ends."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # Large star: every larger neighbour of a node is tied to the smallest node around it.
    large = both.join(least, both["a"] == least["u"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # Small star: a node and its smaller neighbours are tied to the smallest of them.
    tied = large.join(low.withColumnRenamed("a", "u"), large["a"] == F.col("u")).filter(F.col("b") != F.col("m"))
    small = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a link (a, b); the root is the smallest node that can be reached.

    Each round is stored in the shared folder and one row of checks comes to the driver. Rounds end when every node has
    one link, to a node that has none to a smaller one. No node's links are gathered in one task: hubs are aggregated
    before the shuffle, and the joins can be split. Links of a node with itself, repeated ones and nulls do no harm.
    """
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, now = mark, stored(_stars(now), "links")
