"""Cross-validation from sufficient statistics.

Gaussian models need only counts, means and variances per class. One aggregate
over the rows gives them per (fold, class); the training part of a fold is the
merge of the other folds' statistics, so all folds and all families of models
are fitted by one scan, and scored by a second one, instead of a fit per fold.

Families: ``naive_bayes`` (a variance per class and feature) and
``discriminant`` (diagonal linear discriminant analysis: one variance per
feature, pooled over the classes).

Missing values (null, NaN) enter no statistic and add nothing to a row's
scores. Rows without a label or a fold are left out. A class that a fold's
training part lacks is never predicted there; equal scores go to the first
class by code point. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("naive_bayes", "discriminant")
MAX_GROUPS = 20_000        # (fold, class) pairs: their statistics are the model, held by every task
VARIANCE_FLOOR = 1e-9      # of the largest variance of a training part


@dataclass
class GaussianModel:
    """Priors (log), means and variances per class (rows) and feature (columns);
    a mean of NaN marks a feature without values in that class."""
    labels: list[str]
    log_prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Joint log densities, one column per class."""
        out = np.empty((len(x), len(self.labels)))
        for c in range(len(self.labels)):
            d = x - self.mean[c]
            out[:, c] = self.log_prior[c] - 0.5 * np.nansum(d * d / self.var[c] + np.where(np.isnan(d), np.nan, np.log(self.var[c])), axis=1)
        return out


def fold_statistics(df: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """One row per (fold, class): ``n`` rows and, per feature, the arrays ``cnt``,
    ``mean`` and ``var`` (population) of its values. Map-side partial sums, so a
    class that holds a third of the rows is pre-combined in every task."""
    x = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    rows = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    rows = rows.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("string").alias("label"),
                       *[x[f].alias(f"x{i}") for i, f in enumerate(features)])
    names = [f"x{i}" for i in range(len(features))]
    zero = F.lit(0.0)
    return rows.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count(c) for c in names]).alias("cnt"),
        F.array(*[F.coalesce(F.avg(c), zero) for c in names]).alias("mean"),
        F.array(*[F.coalesce(F.var_pop(c), zero) for c in names]).alias("var"))


def merged(parts: Sequence[tuple]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(n, cnt, mean, var) of disjoint parts together (parallel variance formula)."""
    n = float(sum(p[0] for p in parts))
    cnt = np.sum([p[1] for p in parts], axis=0)
    safe = np.maximum(cnt, 1.0)
    mean = np.sum([p[1] * p[2] for p in parts], axis=0) / safe
    var = np.sum([p[1] * (p[3] + (p[2] - mean) ** 2) for p in parts], axis=0) / safe
    return n, cnt, mean, var


def _fit(stats: dict[str, tuple], family: str) -> GaussianModel:
    labels = sorted(stats)
    n = np.array([stats[c][0] for c in labels])
    cnt = np.array([stats[c][1] for c in labels])
    mean = np.array([stats[c][2] for c in labels])
    var = np.array([stats[c][3] for c in labels])
    if family == "discriminant":
        pooled = (cnt * var).sum(axis=0) / np.maximum(cnt.sum(axis=0), 1.0)
        var = np.broadcast_to(pooled, var.shape)
    elif family != "naive_bayes":
        raise ValueError(f"unknown family {family!r}")
    floor = VARIANCE_FLOOR * float(merged([stats[c] for c in labels])[3].max(initial=0.0))
    var = np.maximum(var, floor if floor > 0 else 1.0)
    return GaussianModel(labels, np.log(n / n.sum()), np.where(cnt > 0, mean, np.nan), var)


def fold_models(df: DataFrame, features: Sequence[str], label: str, fold: str,
                families: Sequence[str] = FAMILIES) -> dict[tuple[str, int], GaussianModel]:
    """A model per (family, fold), each of the rows outside its fold."""
    got = fold_statistics(df, features, label, fold).limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} pairs of fold and class: is {label!r} a class?")
    per: dict[str, dict[int, tuple]] = {}
    for r in got:
        per.setdefault(r["label"], {})[r["fold"]] = (r["n"], np.array(r["cnt"], float), np.array(r["mean"]), np.array(r["var"]))
    out = {}
    for f in sorted({r["fold"] for r in got}):
        train = {c: merged([s for g, s in sorted(by.items()) if g != f]) for c, by in per.items() if set(by) - {f}}
        if train:
            out |= {(family, f): _fit(train, family) for family in families}
    return out


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, keep: Sequence[str] = (),
                families: Sequence[str] = FAMILIES) -> DataFrame:
    """Every labelled row scored by the models of the other folds: ``keep``,
    fold, actual, family, predicted, one row per family. Rows whose fold has no
    model (it is the only one) are left out."""
    models = df.sparkSession.sparkContext.broadcast(fold_models(df, features, label, fold, families))
    features, keep = list(features), list(keep)
    rows = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(fold).cast("int").alias("fold"),
        F.col(label).cast("string").alias("actual"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    kept = [f"k{i}" for i in range(len(keep))] + ["fold", "actual"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            folds = b.column("fold").to_numpy(zero_copy_only=False)
            for family in families:
                for f in np.unique(folds):
                    m = models.value.get((family, int(f)))
                    if m is None:
                        continue
                    at = np.flatnonzero(folds == f)
                    best = m.scores(x[at]).argmax(axis=1)
                    part = b.select(kept).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array([family] * len(at), pa.string()), pa.array([m.labels[i] for i in best], pa.string())],
                        names=[*kept, "family", "predicted"])

    schema = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in rows.select(*kept).schema), "family string", "predicted string"])
    out = rows.mapInArrow(score, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "fold", "actual", "family", "predicted")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Per (family, fold): accuracy, and precision, recall and F1 weighted by the
    classes' rows. All from the confusion counts, one small aggregate; a class
    that is never predicted has precision 0."""
    by = ["family", "fold"]
    cells = predictions.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("cnt"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0)
    # both regroupings read the counted cells, at most classes^2 a fold
    rows = cells.groupBy(*by, F.col("actual").alias("label")).agg(F.sum("cnt").alias("support"), F.sum(hit).alias("tp"))
    cols = cells.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("cnt").alias("guessed"))
    per = rows.join(cols, [*by, "label"], "left")
    p = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    r = F.col("tp") / F.col("support")
    f1 = F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0)
    n = F.sum("support")
    return per.groupBy(*by).agg(n.alias("n"), (F.sum("tp") / n).alias("accuracy"),
                                (F.sum(p * F.col("support")) / n).alias("precision"),
                                (F.sum(r * F.col("support")) / n).alias("recall"),
                                (F.sum(f1 * F.col("support")) / n).alias("f1"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Families by mean accuracy over their folds (``cv_mean``), its
    population deviation (``cv_std``), means of the other metrics, and a rank;
    equal means rank by name. One row per family, so its window is small."""
    from pyspark.sql import Window

    per = metrics.groupBy("family").agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                                        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                        F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n_folds"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cv_mean"), "family")))
