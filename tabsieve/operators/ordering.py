"""Ordering, ranking and limits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str, n: int, tie: Sequence[str] = (), desc: bool = True) -> DataFrame:
    """O1/O2: sort by ``by`` (desc by default) with tie keys, keep n rows.
    Plans as TakeOrderedAndProject: a per-partition top-n, then a merge."""
    o = F.desc(by) if desc else F.asc(by)
    return df.orderBy(o, *[F.asc(t) for t in tie]).limit(n)


def page(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """O3: skip/limit over a total order (quirk 5: never unordered). With a
    limit it plans as a per-task top-(skip + limit) merged in one task; for
    pages far down the order use ``deep_page``."""
    if limit is None:
        return deep_page(df, order, skip) if skip else df.orderBy(*order)
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(limit)


def deep_page(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """O3 at any depth: rows skip + 1 to skip + limit (or all after skip), cut
    by position from ``global_positions`` (range partitions, no single-task
    step); rows come back sorted by the same order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    g = global_positions(df, cols, name="__pos")
    keep = F.col("__pos") > F.lit(skip)
    if limit is not None:
        keep = keep & (F.col("__pos") <= F.lit(skip + limit))
    return g.filter(keep).orderBy("__pos").drop("__pos")


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "position",
                     running: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact 1..N position over a total order, plus running sums
    (``running_<col>``), without moving the input into one task.

    Rows are range-partitioned on the order (partition i holds the i-th key
    range) and sorted inside each range; each row gets its range number and
    its index inside the range (the low bits of
    ``monotonically_increasing_id``). A range exchange samples its bounds
    anew on every execution, so these rows are written once as a reliable
    checkpoint (shared checkpoint folder) and every later use reads the
    same split. One aggregate gives each range's row count and column sums;
    a prefix over them (one row per range, broadcast) gives the offsets:
    position = offset + index + 1; running sums add a window partitioned by
    range and ordered by the index."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    r = r.withColumn("__i", F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)).checkpoint(eager=True)
    per = r.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(running)])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over <= n rows
    offs = per.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
                      *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(running))])
    out = r.join(F.broadcast(offs), "__p").withColumn(name, F.col("__i") + F.lit(1) + F.col("__o"))
    upto = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    for i, c in enumerate(running):
        out = out.withColumn(f"running_{c}", F.sum(c).over(upto) + F.col(f"__o{i}"))
        # the column total from the per-range sums (one row per range)
        out = out.withColumn(f"total_{c}", F.lit(per.agg(F.sum(f"__s{i}")).scalar()))
    return out.drop("__p", "__i", "__o", *[f"__o{i}" for i in range(len(running))])


def rank_numbers(df: DataFrame, by: str, tie: Sequence[str] = (), desc: bool = True, name: str = "rank") -> DataFrame:
    """1..N numbering by ``by`` (desc by default), ties by ``tie``
    (leaderboards); distributed, see ``global_positions``."""
    o = F.desc(by) if desc else F.asc(by)
    return global_positions(df, [o, *[F.asc(t) for t in tie]], name=name)


def cumulative_share(df: DataFrame, value: str, tie: str, name: str = "cumulative") -> DataFrame:
    """Running sum of ``value`` in descending order (ties by ``tie``),
    plus the running share of the total and the position."""
    g = global_positions(df, [F.desc(value), F.asc(tie)], name="position", running=[value])
    return (g.withColumnRenamed(f"running_{value}", name)
             .withColumn("share", F.col(name) / F.col(f"total_{value}")).drop(f"total_{value}"))


def first_reaching(cum: DataFrame, thresholds: Sequence[float], share_col: str = "share",
                   pos_col: str = "position") -> DataFrame:
    """For each threshold, the first position whose running share >= it
    (null when never reached). One aggregate over the bounded frame."""
    aggs = [F.min(F.when(F.col(share_col) >= F.lit(t) - F.lit(1e-12), F.col(pos_col))).alias(f"t{i}")
            for i, t in enumerate(thresholds)]
    one = cum.agg(*aggs)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_items")) for i, t in enumerate(thresholds)]
    return one.select(F.inline(F.array(*rows)))


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """K best rows per group. ``row_number() <= k`` over a partitioned
    window plans as WindowGroupLimit: each task keeps only k rows per group
    before the exchange, so a hot group is cut map-side."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def best_row(df: DataFrame, score: str, tie: str, ok: Column | None = None) -> DataFrame:
    """The single best row (strictly greater wins, first by ``tie``)."""
    d = df if ok is None else df.filter(ok)
    return d.orderBy(F.desc(score), F.asc(tie)).limit(1)
