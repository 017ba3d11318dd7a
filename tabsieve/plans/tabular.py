"""Profiling, selection, distribution, split and evaluation composites on the
driver tables. ``lineitem`` supplies the numeric feature frame; nulls and
degenerate columns are derived inside the query (the tables hold none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_label, round_half_up
from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import ordering as O
from ..operators import split as S
from ..operators.correlation import correlation_pairs
from ..operators.profile import select_features
from ..sources.tables import Tables
from . import catalogue as C

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "sparse_tax", "tax_floor", "gross", "unit_price"]
# Part sizes in tens; the shares' base is every size, also those below the first bucket.
SIZE_BUCKETS = [("half to one", 0.5, 1.0), ("one to two", 1.0, 2.0), ("two to four", 2.0, 4.0), ("four and more", 4.0, None)]
THRESHOLDS = [0.5, 0.75, 0.9, 0.95]


def feature_frame(t: Tables) -> DataFrame:
    """Numeric features: four lineitem measures (zero discounts as null), a
    mostly-null column, a constant column and two near-copies."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"), "l_tax",
        F.when(F.col("l_quantity") > 20, F.col("l_tax")).alias("sparse_tax"),
        F.floor("l_tax").cast("double").alias("tax_floor"),
        (F.col("l_extendedprice") * (F.lit(1) + F.col("l_tax"))).alias("gross"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


def describe(t: Tables) -> DataFrame:
    return A.describe_columns(feature_frame(t), FEATURES, digits=6)


def null_profile(t: Tables) -> DataFrame:
    nf = A.null_fractions(feature_frame(t), FEATURES)
    return nf.select("pos", "column", "nulls", round_half_up("null_fraction", 6).alias("null_fraction"),
                     F.lit(nf.agg(F.sum("nulls")).scalar()).alias("total_missing"))


def moments(t: Tables) -> DataFrame:
    m = A.column_moments(feature_frame(t), FEATURES)
    return m.select("pos", "column", "n", round_half_up("mean", 6).alias("mean"),
                    round_half_up("median", 6).alias("median"), round_half_up("std_pop", 6).alias("std_pop"),
                    round_half_up("var_samp", 3).alias("var_samp"),
                    (F.col("var_samp") == 0).alias("zero_variance"))


def correlation(t: Tables) -> DataFrame:
    p = correlation_pairs(feature_frame(t), FEATURES)
    return p.select("i", "j", "col_i", "col_j", "n", round_half_up("r", 6).alias("r"))


def feature_selection(t: Tables) -> DataFrame:
    s = select_features(feature_frame(t), FEATURES)
    return s.select("pos", "column", round_half_up("null_fraction", 6).alias("null_fraction"),
                    round_half_up("variance", 3).alias("variance"), "corr_partner",
                    round_half_up("partner_abs_r", 6).alias("partner_abs_r"), "kept", "reason")


def value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t.events, "event_type", normalize=True)


def repeated_groups(t: Tables) -> DataFrame:
    return A.repeated_groups(t.orders, "o_custkey", top=10)


def range_share(t: Tables) -> DataFrame:
    return A.range_share(t.orders, "o_totalprice", 200000.0, 320000.0)


def size_buckets(t: Tables) -> DataFrame:
    return A.bucket_shares(t.part.select((F.col("p_size") / 10.0).alias("size")), "size", SIZE_BUCKETS)


def family_summary(t: Tables) -> DataFrame:
    return A.grouped_summary(t.lineitem, "l_returnflag", "l_extendedprice", other="l_discount")


def width_histogram(t: Tables) -> DataFrame:
    h = A.width_histogram(t.orders, "o_totalprice", 20)
    return h.select("bin", round_half_up("lower", 6).alias("lower"), "count")


def brand_importance(t: Tables) -> DataFrame:
    """Revenue share per brand: lineitem revenue is pre-aggregated per part
    (map-side partial sums) before the join to ``part``, so the join moves
    one row per part, not per line."""
    rev = t.lineitem.groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("rev"))
    byb = rev.join(t.part.select("p_partkey", "p_brand"), rev["l_partkey"] == F.col("p_partkey")) \
             .groupBy("p_brand").agg(F.sum("rev").alias("rev"))
    total = byb.agg(F.sum("rev")).scalar()
    return byb.select("p_brand", (F.col("rev") / total).alias("importance"))


def pareto(t: Tables) -> DataFrame:
    c = O.cumulative_share(brand_importance(t), "importance", "p_brand")
    return c.select("position", "p_brand", round_half_up("importance", 6).alias("importance"),
                    round_half_up("cumulative", 6).alias("cumulative"))


def pareto_thresholds(t: Tables) -> DataFrame:
    c = O.cumulative_share(brand_importance(t), "importance", "p_brand")
    return O.first_reaching(c, THRESHOLDS)


def importance_summary(t: Tables) -> DataFrame:
    s = A.importance_summary(brand_importance(t), "importance", tiny=0.04)
    return s.select(round_half_up("max", 6).alias("max"), round_half_up("mean", 6).alias("mean"), "n_above", "n_zero")


def class_weights(t: Tables) -> DataFrame:
    w = S.class_weights(t.lineitem, "l_returnflag")
    return w.select("l_returnflag", "count", round_half_up("weight", 9).alias("weight"))


def stratified_split(t: Tables) -> DataFrame:
    s = S.stratified_split(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"),
                           "l_returnflag", ["l_orderkey", "l_linenumber"], test=0.2, val=0.1, seed=42)
    return s.select("l_orderkey", "l_linenumber", "l_returnflag", "rank", "split")


def kfold(t: Tables) -> DataFrame:
    f = S.stratified_folds(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"),
                           "l_returnflag", ["l_orderkey", "l_linenumber"], k=5, seed=7)
    return f.select("l_orderkey", "l_linenumber", "l_returnflag", "fold")


def _scored_labels(t: Tables) -> DataFrame:
    return C.labelled_orders(t).select(canonical_label("actual_disposition").alias("actual"),
                      canonical_label("disposition").alias("predicted"))


def confusion(t: Tables) -> DataFrame:
    return E.confusion_matrix(_scored_labels(t), "actual", "predicted", ["FILLED", "OPEN", "PARTIAL_FILL"])


def class_report(t: Tables) -> DataFrame:
    return E.classification_report(_scored_labels(t), "actual", "predicted", digits=6)
