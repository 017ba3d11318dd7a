"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs): root is the
    least node reachable.

    Alternates large stars (each node's greater neighbours are tied to its
    least neighbour) and small stars (its lesser ones are), which ends after
    about log(nodes) rounds. Each round is one partial minimum per node and
    one join; a node with very many links is split by AQE. Every round is
    checkpointed in the shared folder. Loops and repeated links do no harm.
    """
    tied = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = tied.union(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = tied.groupBy("a").agg(F.min("b").alias("m"))
        small = tied.join(least, "a")
        tied = checkpointed(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(tied.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return tied.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        tied.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
