"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.folders import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of links (``a``, ``b``).

    Large and small stars take turns: each node links its larger, then its smaller
    neighbours to the least node near it, until nothing changes. The number of rounds grows
    with the logarithm of the longest path, and no round has more links than the one before.
    Minima are combined before they are shuffled; the joins back are split by adaptive
    execution where one node has many links. Null ends and self-links are ignored.
    """
    edges = stored(
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct())
        edges = stored(small, name)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if before == state[:2] and state[0] == state[2]:
            break
        before = state[:2]
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
