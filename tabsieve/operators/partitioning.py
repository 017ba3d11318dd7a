"""Partition-count guards.

A scan yields one task per file split; tables stored as a few large row
groups give fewer tasks than cores, which leaves CPU-heavy per-row work
(regex, Python batches, sketches) on one core. ``spread`` round-robins such
inputs across the default parallelism. It is a no-op on large inputs,
which already have more splits than cores, so no shuffle is added at scale.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (file sizes through
    projections/filters); planning only, nothing is executed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _already_spread(df: DataFrame) -> bool:
    p = df._jdf.queryExecution().optimizedPlan()
    while p.nodeName() in ("Project", "Filter") and p.children().size() == 1:
        p = p.children().apply(0)
    return p.nodeName() in ("Repartition", "RepartitionByExpression")


# Above this size an input is never reshuffled just to add tasks: it already
# spans dozens of splits, and a shuffle of it would cost more than it gains.
SPREAD_MAX_BYTES = 8 << 30
# What a task gets of small files.
GATHERED_BYTES = 2 << 20


def split_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes, however it is spelt
    (``16m``, ``128MB``, ``1g``): Spark's own configuration parses it."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def is_narrow(df: DataFrame) -> bool:
    """Small enough to fit in fewer splits than cores, i.e. below
    parallelism x maxPartitionBytes by the plan estimate, and small in
    absolute terms (``SPREAD_MAX_BYTES``), so a 1000-executor cluster does
    not reshuffle a 500 GB table to double its task count. (Asking the RDD
    for its partition count would execute the shuffle stages of an adaptive
    plan, so it is not used.)"""
    if df.isStreaming or _already_spread(df):
        # a stream has no size to check; micro-batches keep the source's splits
        return False
    return estimated_bytes(df) < min(parallelism(df) * split_bytes(df.sparkSession), SPREAD_MAX_BYTES)


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(parallelism(df)) if is_narrow(df) else df


def gather(df: DataFrame) -> DataFrame:
    """Many small files in few tasks. A scan counts some MB for opening a
    file, so thousands of files of some KB give a task for every few of them,
    whose start costs more than its work. No shuffle: tasks take several of
    the scan's partitions, no more than some MB (a split at most) or a quarter
    of what falls to a core. A scan has its largest files first, so with few
    tasks the first one would take far more bytes than the others."""
    return df.coalesce(max(4 * parallelism(df), -(-estimated_bytes(df) // min(GATHERED_BYTES, split_bytes(df.sparkSession)))))


@contextmanager
def reusable(df: DataFrame):
    """Input for several passes: small (narrow) inputs are spread and kept
    in memory/disk for the passes, then released; large inputs are yielded
    unchanged and simply re-scanned (pruned columnar reads)."""
    if is_narrow(df):
        d = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield d
        finally:
            d.unpersist()
    else:
        yield df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """A derived table read by several jobs (e.g. a join result feeding many
    summaries): written once as Parquet in a fresh folder under the shared
    ``spark.checkpoint.dir`` and read back, so the jobs scan (and prune)
    the written columns instead of each re-running the joins. The files
    survive executor loss (unlike a local checkpoint or a cache)."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
