"""Tree-structure metrics from a saved tree-ensemble model.

``pyspark.ml`` saves random forests and boosted trees as a Parquet node
table (``treeID``, ``nodeData`` with id, leftChild, rightChild, split...).
Depth is found by expanding the frontier level by level with a join of the
(small) node table, a round per level until no node is left.
"""

from __future__ import annotations

from itertools import count
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def node_table(spark: SparkSession, model_path: str) -> DataFrame:
    """Flat node table (treeID, id, left, right, feature, gain, prediction)."""
    d = spark.read.parquet(f"{model_path.rstrip('/')}/data")
    if "treeID" not in d.columns:  # single decision tree
        d = d.withColumn("treeID", F.lit(0))
    n = d.select("treeID", "nodeData.*") if "nodeData" in d.columns else d
    return n.select("treeID", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                    F.col("split.featureIndex").alias("feature"), "gain", "prediction")


def node_depths(nodes: DataFrame) -> DataFrame:
    """(treeID, id, depth) by level-wise expansion from the roots (id 0)."""
    edges = nodes.filter(F.col("left") >= 0).select(
        "treeID", F.col("id").alias("parent"), F.explode(F.array("left", "right")).alias("child")).checkpoint()
    level = nodes.filter(F.col("id") == 0).select("treeID", "id", F.lit(0).alias("depth"))
    out = level
    for depth in count(1):
        parents = level.select("treeID", F.col("id").alias("parent"))
        nxt = (parents.join(edges, ["treeID", "parent"])
                      .select("treeID", F.col("child").alias("id"), F.lit(depth).alias("depth"))).checkpoint()
        if nxt.isEmpty():
            break
        out = out.unionByName(nxt)
        level = nxt
    return out


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, leaves, splits, depth."""
    depth = node_depths(nodes).groupBy("treeID").agg(F.max("depth").alias("depth"))
    counts = nodes.groupBy("treeID").agg(F.count(F.lit(1)).alias("n_nodes"),
                                         F.count_if(F.col("left") < 0).alias("n_leaves"),
                                         F.count_if(F.col("left") >= 0).alias("n_splits"))
    return counts.join(depth, "treeID")


def tree_summary(metrics: DataFrame) -> DataFrame:
    """Mean / min / max / population std of depth and node counts."""
    aggs = []
    for c in ("depth", "n_nodes", "n_leaves"):
        aggs += [F.mean(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.stddev_pop(c).alias(f"{c}_std")]
    return metrics.agg(F.count(F.lit(1)).alias("n_trees"), *aggs)


def split_counts(nodes: DataFrame, names: Sequence[str] | None = None, top: int | None = 20) -> DataFrame:
    """Number of splits per feature ('weight' importance), top N."""
    s = nodes.filter(F.col("left") >= 0).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
    if names:
        s = s.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1))
    s = s.orderBy(F.desc("splits"), F.asc("feature"))
    return s.limit(top) if top else s


def nodes_of(nodes: DataFrame, tree_ids: Sequence[int]) -> DataFrame:
    """The nodes of chosen trees."""
    return nodes.filter(F.col("treeID").isin(list(tree_ids))).orderBy("treeID", "id")
