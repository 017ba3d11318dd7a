"""Evaluation as plain tables.

Everything derives from the long-form confusion table (actual, predicted,
count): one small aggregate over the scored rows, after which all metrics
are arithmetic on at most k^2 rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = "label string, precision double, recall double, f1 double, support long"


def confusion_long(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A23 long form: (actual, predicted, count) over non-null pairs."""
    return (df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
              .groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """A23 matrix: one row per true class, one column per predicted class
    (fixed class list, so the pivot needs no extra pass), zeros filled."""
    cl = confusion_long(df, actual, predicted)
    m = cl.groupBy("actual").pivot("predicted", list(classes)).agg(F.sum("count"))
    return m.fillna(0, subset=list(classes)).select("actual", *[F.col(c).cast("long").alias(c) for c in classes])


def report_from_long(cl: DataFrame, digits: int | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support plus 'accuracy',
    'macro avg' and 'weighted avg' rows, from the long confusion table.
    Zero division gives 0 (as the reference's report does)."""
    classes = cl.select(F.col("actual").alias("label")).union(cl.select(F.col("predicted").alias("label"))).distinct()
    tp = cl.filter(F.col("actual") == F.col("predicted")).groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("tp"))
    sup = cl.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    prd = cl.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("npred"))
    per = (classes.join(tp, "label", "left").join(sup, "label", "left").join(prd, "label", "left")
                  .fillna(0, subset=["tp", "support", "npred"]))
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": p, "recall": r})
    per = per.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    per = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"), "tp")
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), (F.col("tp") / F.col("n")).alias("precision"),
                     (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), (F.col("sp") / F.col("k")).alias("precision"),
                       (F.col("sr") / F.col("k")).alias("recall"), (F.col("sf") / F.col("k")).alias("f1"),
                       F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                          F.col("n").cast("long").alias("support"))
    out = per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)
    if digits is not None:
        from ..functions.scalar import round_half_up
        out = out.select("label", *[round_half_up(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")
    return out


def classification_report(df: DataFrame, actual: str, predicted: str, digits: int | None = None) -> DataFrame:
    """A24 from scored rows. The long confusion table (at most k^2 rows, k =
    number of classes) is computed once, as a checkpoint in the shared folder
    that every metric reads."""
    return report_from_long(confusion_long(df, actual, predicted).checkpoint(), digits)


def report_from_matrix(spark: SparkSession, matrix: Sequence[Sequence[int]], classes: Sequence[str],
                       digits: int | None = None) -> DataFrame:
    """A24 from a saved confusion matrix (rows true, columns predicted)."""
    rows = [(classes[i], classes[j], int(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v]
    cl = spark.createDataFrame(rows, "actual string, predicted string, count long")
    return report_from_long(cl, digits)


def agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Overall accuracy and per-class recall (classes with support)."""
    m = F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)).cast("int")
    return df.filter(F.col(actual).isNotNull()).groupBy(actual).agg(
        F.count(F.lit(1)).alias("support"), F.sum(m).alias("correct"), F.avg(m).alias("recall"))


def score_summary(spark: SparkSession, scores: Sequence[float]) -> DataFrame:
    """Mean and population std of fold scores."""
    d = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold int, score double")
    return d.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
                 F.collect_list(F.struct("fold", "score")).alias("folds"))
