"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def star_roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    Alternates the large-star and small-star steps: every node hangs its larger, then its
    smaller neighbours on the smallest one it knows, until the links are stars. Each step is
    a partial aggregation, kept as a table, and an equi-join with it, so that both sides are
    plain shuffles and a hub with many links is split like any skewed key; rounds grow with the logarithm of the longest chain. Only a count comes to the driver.
    """
    edges = keep(
        links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter(F.col("u") != F.col("v")).distinct()
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(keep(_least(both)), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter(F.col("u") != F.col("v")).distinct())
        least = keep(_least(large))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = keep(small.union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct())
        # stars: every node has one link, and no root has a link of its own
        counts = found.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        unfinished = counts.filter("n > 1").select("u").union(found.join(found.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u"))
        if unfinished.isEmpty():
            return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = found
