"""Aggregations. Each is one pass (one Aggregate node) over its input; Spark
splits it into map-side partial and reduce-side final aggregation, so a hot
key is pre-combined on every executor before the shuffle."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import _c, all_not_null, canonical_label, pct, round_half_up
from .quantiles import column_stats


# ---------------------------------------------------------------- A2/A5/A6/A7/A8/A9
def prediction_stats(df: DataFrame, pred: str, actual: str, classes: Sequence[str],
                     coord_cols: Sequence[str] = (), distance_col: str | None = None,
                     source_col: str | None = None, strict_labels: bool = False) -> DataFrame:
    """Q5 in ONE aggregate: totals, predicted/actual counts per class,
    percentages, coordinate/distance coverage, agreement overall and per
    class (restricted to classes with support: null otherwise).

    Labels are canonicalised (upper, '_' for spaces) unless ``strict_labels``.
    """
    p = _c(pred) if strict_labels else canonical_label(pred)
    a = _c(actual) if strict_labels else canonical_label(actual)
    match = p == a
    aggs: list[Column] = [F.count(F.lit(1)).alias("total")]
    for k in classes:
        key = k.lower().replace(" ", "_")
        kk = k if strict_labels else k.upper().replace(" ", "_")
        aggs += [F.count_if(p == kk).alias(f"pred_{key}"),
                 F.count_if(a == kk).alias(f"actual_{key}"),
                 F.count_if((a == kk) & match).alias(f"_hit_{key}")]
    if coord_cols:
        aggs.append(F.count_if(all_not_null(coord_cols)).alias("with_coordinates"))
    if distance_col:
        aggs.append(F.count(distance_col).alias("with_distance"))
    if source_col:
        aggs.append(F.min(source_col).alias("disposition_source"))
    aggs.append(F.count_if(match).alias("correct"))
    g = df.agg(*aggs)
    out = [F.col("total")]
    for k in classes:
        key = k.lower().replace(" ", "_")
        out += [F.col(f"pred_{key}"), pct(f"pred_{key}", "total").alias(f"pred_pct_{key}"),
                F.col(f"actual_{key}")]
    if coord_cols:
        out.append(F.col("with_coordinates"))
    if distance_col:
        out.append(F.col("with_distance"))
    if source_col:
        out.append(F.col("disposition_source"))
    out += [F.col("correct"), pct("correct", "total").alias("accuracy")]
    for k in classes:
        key = k.lower().replace(" ", "_")
        out.append(F.when(F.col(f"actual_{key}") > 0,
                          round_half_up(F.col(f"_hit_{key}") * 100.0 / F.col(f"actual_{key}"), 2))
                   .alias(f"class_acc_{key}"))
    return g.select(*out)


def conditional_counts(df: DataFrame, conds: dict[str, Column], total: str | None = "total") -> DataFrame:
    """A1 + A2: row count and any number of conditional counts in one pass."""
    aggs = ([F.count(F.lit(1)).alias(total)] if total else []) + [F.count_if(c).alias(n) for n, c in conds.items()]
    return df.agg(*aggs)


# ---------------------------------------------------------------- A3/A4
def value_counts(df: DataFrame, col: str, normalize: bool = False, count_col: str = "count") -> DataFrame:
    """A3 (A4 with ``normalize``): counts per non-null value, ordered by count
    desc then value. The share divides by a scalar subquery over the
    grouped counts, never by a single-partition window."""
    nn = df.filter(F.col(col).isNotNull())
    vc = nn.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
    if normalize:
        # the total is the sum of the group counts: the subquery shares the
        # grouped aggregate's exchange instead of scanning the input again
        total = vc.agg(F.sum(count_col)).scalar()
        vc = vc.withColumn("percent", round_half_up(F.col(count_col) * 100.0 / total, 6))
    return vc.orderBy(F.desc(count_col), F.col(col))


# ---------------------------------------------------------------- A10/A16/A17/A18/A20/A21
def describe_columns(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """A10: mean / median / min / max / non-null count per column, long form
    (column, mean, median, min, max, n, total). Statistics come from
    ``column_stats`` (exact median with bounded memory); the per-column
    scalars form a small frame."""
    st = column_stats(df, cols, ("mean", "min", "max"))
    rows = [(d["column"], d["mean"], d["median"], d["min"], d["max"], d["count"], d["total"]) for d in st]
    out = df.sparkSession.createDataFrame(
        rows, "column string, mean double, median double, min double, max double, n long, total long")
    if digits is not None:
        out = out.withColumns({"mean": round_half_up("mean", digits), "median": round_half_up("median", digits)})
    return out


def null_fractions(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count and fraction, long form, one pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"{i}").alias("nulls"),
                     F.when(F.col("__n") > 0, F.col(f"{i}") / F.col("__n")).alias("null_fraction"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def column_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance, exact median, mean, population std."""
    st = column_stats(df, cols, ("mean", "stddev_pop", "var_samp"))
    rows = [(d["pos"], d["column"], d["count"], d["mean"], d["median"], d["stddev_pop"], d["var_samp"]) for d in st]
    return df.sparkSession.createDataFrame(
        rows, "pos int, column string, n long, mean double, median double, std_pop double, var_samp double")


# ---------------------------------------------------------------- A11/A12
def repeated_groups(df: DataFrame, key: str, top: int | None = 10, member: str | None = None) -> DataFrame:
    """Groups of size > 1 (null keys dropped) ordered by size desc,
    key asc; ``n_groups`` = number of such groups before the top-N cut.
    ``member`` (quirk 23): size = distinct non-null members instead of rows,
    so rows repeated by a one-to-many join are not counted twice (Spark
    plans it as a two-level aggregate: (key, member) first, so a hot group
    is still pre-combined map-side)."""
    size = F.count_distinct(F.col(member)) if member else F.count(F.lit(1))
    g = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(size.alias("size"))
         .filter(F.col("size") > 1))
    g = g.withColumn("n_groups", g.agg(F.count(F.lit(1))).scalar())
    g = g.orderBy(F.desc("size"), F.col(key))
    return g.limit(top) if top else g


# ---------------------------------------------------------------- A13/A14
def range_share(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Count in [lo, hi] and its share of all rows (percent, 1 digit)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col(col).between(lo, hi)).alias("in_range")) \
             .withColumn("percent", pct("in_range", "total", 1))


def bucket_shares(df: DataFrame, col: str, edges: Sequence[tuple[str, float, float | None]], digits: int = 1) -> DataFrame:
    """Half-open buckets [lo, hi) (hi None = open end) with count and
    share over ALL non-null values, including those outside every bucket
    (quirk 21). One aggregate; output one row per bucket in the given order."""
    x = F.col(col)
    aggs = [F.count(x).alias("__base")]
    for i, (_, lo, hi) in enumerate(edges):
        cond = (x >= lo) if hi is None else ((x >= lo) & (x < hi))
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(name).alias("bucket"), F.col(f"b{i}").alias("count"),
                     pct(f"b{i}", "__base", digits).alias("percent"))
            for i, (name, _, _) in enumerate(edges)]
    return one.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- A15
def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) pairs with the number of pairs on every row."""
    d = df.select(a, b).distinct()
    return d.withColumn("n_pairs", d.agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------- A26/A27
def grouped_summary(df: DataFrame, key: str, value: str, other: str | None = None, digits: int = 4) -> DataFrame:
    """Per group mean / max / count / sample std of ``value`` (and the
    mean of ``other``), rounded, ordered by mean desc."""
    aggs = [round_half_up(F.mean(value), digits).alias("mean"), F.max(value).alias("max"),
            F.count(value).alias("count"), round_half_up(F.stddev_samp(value), digits).alias("std")]
    if other:
        aggs.append(round_half_up(F.mean(other), digits).alias(f"mean_{other}"))
    return df.groupBy(key).agg(*aggs).orderBy(F.desc("mean"), F.col(key))


# ---------------------------------------------------------------- A28
def width_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max]; the max value falls into the
    last bin. min and max are scalar subqueries (partial min/max per task)."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))   # one aggregate, shared by both subqueries
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    v = df.select(x.alias("__v")).filter(F.col("__v").isNotNull())
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((F.col("__v") - lo) * F.lit(float(bins)) / (hi - lo)).cast("int") + 1, F.lit(bins)))
    h = v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", (lo + (F.col("bin") - 1) * (hi - lo) / F.lit(float(bins))).alias("lower"), "count")


# ---------------------------------------------------------------- A29
def importance_summary(df: DataFrame, col: str = "importance", tiny: float = 0.01) -> DataFrame:
    """Max, mean, count above ``tiny``, count exactly zero."""
    x = F.col(col)
    return df.agg(F.max(x).alias("max"), F.mean(x).alias("mean"),
                  F.count_if(x > tiny).alias("n_above"), F.count_if(x == 0).alias("n_zero"))


# ---------------------------------------------------------------- A31
def first_per_key(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` (deterministic ``dropDuplicates``):
    ``min_by`` is a partial aggregate, so a hot key is combined map-side."""
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in cols if c != key])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()
