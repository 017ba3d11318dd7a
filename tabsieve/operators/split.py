"""Stratified splits, k-fold assignment and class weights.

Exact stratified ranks without a per-label window: a label that holds a
third of all rows would otherwise be ranked in one task. Rows are ordered by
``h = md5(key || seed)``; the first hex digits of ``h`` give a bucket, so the
order by ``h`` equals the order by (bucket, h). Per (label, bucket) counts
are a small aggregate (labels x buckets rows); their running sums give each
bucket's offset inside its label. A row's rank is its bucket offset plus
its row number inside (label, bucket): the window is partitioned by
(label, bucket), so a hot label is spread over many tasks. The bucket count
(4096 and up) grows with the input size estimate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import estimated_bytes

HASH_PREFIX_DIGITS = 3            # at least 16^3 = 4096 buckets per label
MAX_PREFIX_DIGITS = 7             # 16^7 buckets still fit an int
UNLABELLED = "unlabelled"         # the part of rows without a label (folds: null)
BYTES_PER_BUCKET_SET = 64 << 30   # input bytes (plan estimate) per 4096-bucket level


def prefix_digits(df: DataFrame) -> int:
    """Hex digits of the bucket prefix: one more (16x the buckets) for every
    16x of input above 64 GB by Catalyst's size estimate (planning only), so
    a label holding a third of 100 TB is still ranked in small windows. The
    ranks do not depend on it: the order by hash is the order by (prefix,
    hash) for any prefix length."""
    if df.isStreaming:
        return HASH_PREFIX_DIGITS
    est, d = estimated_bytes(df), HASH_PREFIX_DIGITS
    while d < MAX_PREFIX_DIGITS and est > BYTES_PER_BUCKET_SET * 16 ** (d - HASH_PREFIX_DIGITS):
        d += 1
    return d


def order_hash(keys: Sequence[str], seed: int) -> Column:
    """Deterministic, engine-independent order key: md5 of 'k1:k2:...:seed'."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def stratified_rank(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42,
                    digits: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based, per label, by hash order) and ``n_label``; both
    are null on rows without a label, which are kept."""
    digits = digits or prefix_digits(df)
    d = df.withColumn("__h", order_hash(keys, seed)).withColumn(
        "__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("int"))
    counts = d.filter(F.col(label).isNotNull()).groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(label).orderBy("__b")
    offsets = counts.select(
        label, "__b",
        (F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cnt")).alias("__off"),
        F.sum("__cnt").over(Window.partitionBy(label)).alias("n_label"))
    # offsets has at most (#labels x buckets) rows; AQE broadcasts it from its
    # measured runtime size (no extra counting job); when it is large the
    # sort-merge join shares the (label, bucket) partitioning with the window
    d = d.join(offsets, [label, "__b"], "left")
    wr = Window.partitionBy(label, "__b").orderBy("__h", *keys)
    # (the join gives rows without a label a null offset, hence a null rank)
    return d.withColumn("rank", F.col("__off") + F.row_number().over(wr)).drop("__h", "__b", "__off")


def half_up_count(n: Column, frac: float) -> Column:
    """floor(n * frac + 0.5): rows of a class that go to a part."""
    return F.floor(n * F.lit(float(frac)) + F.lit(0.5))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test: float = 0.2, val: float = 0.1,
                     seed: int = 42, col: str = "split") -> DataFrame:
    """M4: exact per-class split. Test takes round(n_c * test) rows of each
    class, validation round((n_c - n_test) * val / (1 - test)) of the rest
    (``val / (1 - test)`` of the rest), train the remainder. Rows without a
    label get the part ``UNLABELLED``."""
    r = stratified_rank(df, label, keys, seed)
    n = F.col("n_label")
    n_test = half_up_count(n, test)
    vf = val / (1.0 - test) if val else 0.0
    n_val = F.floor((n - n_test) * F.lit(vf) + F.lit(0.5))
    return r.withColumn(col, F.when(F.col("rank").isNull(), UNLABELLED).when(F.col("rank") <= n_test, "test")
                             .when(F.col("rank") <= n_test + n_val, "val").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """M5: fold = (rank - 1) mod k inside each class: fold sizes of a class
    differ by at most one. Usable as ``foldCol`` of ``CrossValidator``."""
    r = stratified_rank(df, label, keys, seed)
    return r.withColumn(col, ((F.col("rank") - 1) % k).cast("int"))


def group_split(df: DataFrame, group: str, test: float = 0.2, val: float = 0.1, seed: int = 42,
                col: str = "split") -> DataFrame:
    """Quirk 12: keep every row of a group (one object) in one part. Groups
    are assigned by a hash threshold, so part sizes are approximate (within
    sampling error of the group count); no shuffle is needed."""
    u = (F.conv(F.substring(order_hash([group], seed), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8)))
    return df.withColumn(col, F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Quirk 12 for M5: every row of a group (one object) gets the same fold,
    by the group's hash (fold sizes follow the group count within sampling
    error); no shuffle. Usable as ``foldCol`` of ``CrossValidator``."""
    h = F.conv(F.substring(order_hash([group], seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(col, F.pmod(h, F.lit(k)).cast("int"))


def _group_starts(df: DataFrame, label: str, group: str, seed: int, digits: int) -> DataFrame:
    """One row per group: ``__stratum`` (its most frequent label, the greater
    one of equals; null without labels), ``__w`` (its rows with that label, or
    all its rows), ``__start`` (the ``__w`` of the stratum's groups before it in
    hash order) and ``__total`` (of the stratum). Rows without a group form one."""
    cells = df.groupBy(F.col(group).alias("__g"), F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__c"))
    top = F.max(F.when(F.col("__l").isNotNull(), F.struct("__c", "__l")))
    g = cells.groupBy("__g").agg(top.alias("__top"), F.sum("__c").alias("__n"))
    g = g.select("__g", F.col("__top")["__l"].alias("__stratum"), F.coalesce(F.col("__top")["__c"], F.col("__n")).alias("__w"),
                 order_hash(["__g"], seed).alias("__h"))
    g = g.withColumn("__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("int"))
    sums = g.groupBy("__stratum", "__b").agg(F.sum("__w").alias("__s"))
    w = Window.partitionBy("__stratum").orderBy("__b")
    sums = sums.select(F.col("__stratum").alias("__stratum2"), F.col("__b").alias("__b2"),
                       (F.sum("__s").over(w) - F.col("__s")).alias("__off"),
                       F.sum("__s").over(Window.partitionBy("__stratum")).alias("__total"))
    g = g.join(sums, F.col("__stratum").eqNullSafe(F.col("__stratum2")) & (F.col("__b") == F.col("__b2")))
    inside = Window.partitionBy("__stratum", "__b").orderBy("__h", "__g")
    return g.select("__g", "__stratum", "__w", "__total",
                    (F.col("__off") + F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")).alias("__start"))


def _deal(df: DataFrame, label: str, group: str, part: Column, col: str, seed: int) -> DataFrame:
    starts = _group_starts(df, label, group, seed, prefix_digits(df)).select("__g", part.alias(col))
    # a group may hold a third of the rows: AQE splits its partition of the rows,
    # the other side has one row per group
    return df.join(starts, df[group].eqNullSafe(F.col("__g")), "left").drop("__g")


def stratified_group_split(df: DataFrame, label: str, group: str, test: float = 0.2, val: float = 0.1,
                           seed: int = 42, col: str = "split") -> DataFrame:
    """M4 with quirk 12: no group in two parts, and parts alike in their
    classes. Groups are dealt inside strata (the most frequent label) in hash
    order by quota: the first ``test`` share of the stratum's rows with that
    label is the test part, the next ``val`` share the validation part, and a
    group goes where its middle row falls. So in every stratum each part's
    border is off by at most half of one group; rows of other labels in a group
    follow it (within sampling error of the group count). A group without
    labels is dealt among its like by its rows; rows without a group stay
    together. The running sums are taken in (stratum, hash prefix) cells, so a
    stratum that holds a third of the groups is many small windows."""
    at = (F.col("__start") + F.col("__w") / 2.0) / F.col("__total")
    return _deal(df, label, group, F.when(at < test, "test").when(at < test + val, "val").otherwise("train"), col, seed)


def stratified_group_folds(df: DataFrame, label: str, group: str, k: int = 5, seed: int = 42,
                           col: str = "fold") -> DataFrame:
    """M5 with quirk 12: the same dealing with ``k`` equal quotas."""
    at = (F.col("__start") + F.col("__w") / 2.0) / F.col("__total")
    return _deal(df, label, group, F.least(F.floor(at * k), F.lit(k - 1)).cast("int"), col, seed)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class; one small aggregate."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n = counts.agg(F.sum("count")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", n / (k * F.col("count")))


def with_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach each row's class weight (broadcast lookup of <= #classes rows)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(w, label, "left")   # one row per class: AQE broadcasts it
