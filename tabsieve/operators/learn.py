"""Preparation, training, search and scoring on ``pyspark.ml``.

Statistics for the imputer/scaler come from the training rows in the exact
median's passes (median, mean, population std of the observed values; the
imputed column's moments follow arithmetically) and are applied as plain column
expressions, so scoring stays inside whole-stage codegen. Models are
``pyspark.ml`` estimators; the driver only loops over models and folds,
never over data.
"""

from __future__ import annotations

import json
import random
import traceback
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import standardise
from .quantiles import column_stats

# What ``predict`` and the estimators themselves add to a table.
SCORED_COLUMNS = ["prediction", "rawPrediction", "probability", "predicted", "confidence", "source"]
SCORED_PREFIXES = ["prob_"]


def leak_guard(cols: Sequence[str], scored: Sequence[str] = ()) -> list[str]:
    """``cols`` without those that hold scores or follow from them (quirk 10):
    what ``predict`` adds and the caller's own ``scored`` columns (labels,
    flags and confidences derived from a prediction)."""
    return [c for c in cols if c not in {*SCORED_COLUMNS, *scored} and not any(c.startswith(p) for p in SCORED_PREFIXES)]


# ---------------------------------------------------------------- M6
@dataclass
class Preprocessor:
    """Median imputer + standard scaler fitted on training rows."""
    features: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    missing: str = "train_median"   # or "zero" (quirk 9)

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], missing: str = "train_median") -> "Preprocessor":
        feats = list(features)
        st = column_stats(train, feats, ("mean", "stddev_pop"))
        medians, means, stds = {}, {}, {}
        for d in st:
            c, big_n, n = d["column"], d["total"] or 0, d["count"] or 0
            f = float(d["median"]) if d["median"] is not None else 0.0
            medians[c] = f
            # mean / population std of the imputed column (what the scaler
            # sees), from the observed moments: the N - n filled rows all
            # equal f, so no second pass over the data is needed
            if big_n == 0:
                means[c], stds[c] = 0.0, 0.0
                continue
            m = float(d["mean"]) if n else 0.0
            v = float(d["stddev_pop"]) ** 2 if n else 0.0
            mu = (n * m + (big_n - n) * f) / big_n
            var = (n * v + n * (m - mu) ** 2 + (big_n - n) * (f - mu) ** 2) / big_n
            means[c], stds[c] = mu, var ** 0.5
        return cls(feats, medians, means, stds, missing)

    def columns(self, df: DataFrame) -> list[Column]:
        out = []
        for c in self.features:
            fill = self.medians[c] if self.missing == "train_median" else 0.0
            x = F.coalesce(F.col(c).cast("double"), F.lit(float(fill))) if c in df.columns else F.lit(float(fill))
            out.append(standardise(x, F.lit(self.means[c]), F.lit(self.stds[c])).alias(c))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """P9 + X6 + X7: align to the feature list (absent -> fill), impute,
        standardise, assemble one vector column."""
        cols = [F.col(k) for k in keep if k in df.columns] + self.columns(df)
        x = df.select(*cols)
        return VectorAssembler(inputCols=self.features, outputCol=out, handleInvalid="keep").transform(x)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, s: str) -> "Preprocessor":
        return cls(**json.loads(s))


# ---------------------------------------------------------------- M7/M8/M10
def family_estimator(family: str, params: dict[str, Any], label: str = "label", weight: str | None = "weight",
                     num_features: int | None = None, num_classes: int | None = None, seed: int = 42):
    """One estimator per model family (M10). Boosting families use one
    binary GBT per class (OneVsRest); ExtraTrees maps to a random forest; kNN
    is served by the retrieval operators."""
    p = dict(params)
    common = dict(featuresCol="features", labelCol=label)
    w = {"weightCol": weight} if weight else {}
    if family == "logistic_regression":
        return LogisticRegression(**common, **w, maxIter=int(p.get("max_iter", 100)), regParam=float(p.get("reg", 0.0)),
                                  elasticNetParam=float(p.get("l1_ratio", 0.0)), family="multinomial")
    if family == "decision_tree":
        return DecisionTreeClassifier(**common, **w, maxDepth=int(p.get("max_depth", 5)), seed=seed,
                                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)))
    if family in ("random_forest", "extra_trees"):
        return RandomForestClassifier(**common, **w, numTrees=int(p.get("n_estimators", 20)),
                                      maxDepth=int(p.get("max_depth", 5)), seed=seed,
                                      featureSubsetStrategy=str(p.get("max_features", "auto")),
                                      subsamplingRate=float(p.get("subsample", 1.0)))
    if family in ("gradient_boosting", "xgboost", "lightgbm"):
        gbt = GBTClassifier(featuresCol="features", labelCol=label, **w, maxDepth=int(p.get("max_depth", 3)),
                            maxIter=int(p.get("n_estimators", 10)), stepSize=float(p.get("learning_rate", 0.1)),
                            subsamplingRate=float(p.get("subsample", 1.0)),
                            minInstancesPerNode=max(1, int(float(p.get("min_child_weight", 1)))),
                            minInfoGain=float(p.get("gamma", 0.0)), seed=seed,
                            featureSubsetStrategy=str(p.get("colsample", "all")))
        return OneVsRest(classifier=gbt, **common, **w)
    if family == "linear_svc":
        return OneVsRest(classifier=LinearSVC(featuresCol="features", labelCol=label, **w,
                                              regParam=float(p.get("reg", 0.0)), maxIter=int(p.get("max_iter", 50))),
                         **common, **w)
    if family == "naive_bayes":
        return NaiveBayes(**common, **w, modelType="gaussian")
    if family == "mlp":
        hidden = [int(x) for x in str(p.get("hidden", "16")).split("-") if x]
        return MultilayerPerceptronClassifier(**common, layers=[num_features, *hidden, num_classes],
                                              maxIter=int(p.get("max_iter", 100)), seed=seed)
    raise ValueError(f"unknown family {family!r}")


# Per-family sampling space for the random search (M10); values are lists.
SEARCH_SPACE: dict[str, dict[str, list]] = {
    "logistic_regression": {"reg": [0.0, 0.001, 0.01, 0.1], "l1_ratio": [0.0, 0.5], "max_iter": [50, 100]},
    "decision_tree": {"max_depth": [3, 5, 8, 12], "min_samples_leaf": [1, 2, 5]},
    "random_forest": {"n_estimators": [10, 20, 40], "max_depth": [4, 6, 8], "max_features": ["sqrt", "auto"]},
    "extra_trees": {"n_estimators": [10, 20], "max_depth": [6, 10], "max_features": ["sqrt"], "subsample": [0.8]},
    "gradient_boosting": {"n_estimators": [5, 10], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]},
    "xgboost": {"n_estimators": [5, 10], "max_depth": [3, 4], "learning_rate": [0.1, 0.2], "subsample": [0.8, 1.0]},
    "lightgbm": {"n_estimators": [5, 10], "max_depth": [3, 5], "learning_rate": [0.05, 0.1]},
    "linear_svc": {"reg": [0.0, 0.01, 0.1], "max_iter": [20, 50]},
    "naive_bayes": {},
    "mlp": {"hidden": ["16", "32", "32-16"], "max_iter": [50, 100]},
}


def sample_trials(families: Sequence[str], per_family: int, seed: int = 42) -> list[tuple[int, str, dict]]:
    """Seeded sampling of (trial_id, family, params); params are plain
    Python scalars so they serialise (quirk 16)."""
    rng = random.Random(seed)
    trials, tid = [], 0
    for fam in families:
        space = SEARCH_SPACE[fam]
        for _ in range(per_family):
            trials.append((tid, fam, {k: rng.choice(v) for k, v in sorted(space.items())}))
            tid += 1
    return trials


# ---------------------------------------------------------------- fit / score
def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    r = pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("a")).first()
    return float(r["a"]) if r["a"] is not None else 0.0


def fit_pipeline(train: DataFrame, pre: Preprocessor, label: str, family: str, params: dict,
                 weight: str | None = "weight", num_classes: int | None = None, seed: int = 42):
    """Index the label alphabetically (X9), then fit the family estimator."""
    x = pre.transform(train, keep=[label] + ([weight] if weight else []))
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(x)
    k = num_classes or len(idx.labels)
    est = family_estimator(family, params, label="label_idx", weight=weight, num_features=len(pre.features),
                           num_classes=k, seed=seed)
    model = Pipeline(stages=[idx, est]).fit(x)
    return model, idx.labels


def predict(model: PipelineModel, pre: Preprocessor, df: DataFrame, labels: Sequence[str], keep: Sequence[str],
            source: str = "model") -> DataFrame:
    """Label (decoded), confidence = max probability (X8), one
    probability column per class and a constant source (P12). Models
    without a probability column (OneVsRest) get p_i proportional to
    sigmoid(2 * margin_i), normalised."""
    x = pre.transform(df, keep=keep)
    out = model.transform(x)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        sig = F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
        tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
        probs = F.transform(sig, lambda s: s / tot)
    out = out.withColumn("__p", probs)
    dec = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(labels))
    out = dec.transform(out)
    cols = [F.col(k) for k in keep] + [F.col("predicted"), F.array_max("__p").alias("confidence")]
    cols += [F.col("__p")[i].alias(f"prob_{lab}") for i, lab in enumerate(labels)]
    return out.select(*cols, F.lit(source).alias("source"))


class BoostedOvR:
    """M7 model: one binary boosted-tree model per class (one-vs-rest).
    ``transform`` adds ``rawPrediction`` (vector of per-class margins) and
    ``prediction`` (index of the largest margin, first on ties), the columns
    ``predict`` turns into labels and normalised sigmoid probabilities.
    ``stages[-1].models`` gives the per-class models (importances, summary)."""

    def __init__(self, indexer, models: list):
        self.models = models
        self.stages = [indexer, self]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.stages[0].transform(df) if self.stages[0].getInputCol() in df.columns else df
        margins = []
        for i, m in enumerate(self.models):
            mi = m.copy()
            mi.setRawPredictionCol(f"__raw{i}").setPredictionCol(f"__pred{i}").setProbabilityCol(f"__prob{i}")
            out = mi.transform(out)
            margins.append(vector_to_array(f"__raw{i}")[1])
        raw = F.array(*margins)
        tmp = [f"__{k}{i}" for i in range(len(self.models)) for k in ("raw", "pred", "prob")]
        return (out.withColumn("rawPrediction", array_to_vector(raw))
                   .withColumn("prediction", (F.array_position(raw, F.array_max(raw)) - 1).cast("double"))
                   .drop(*tmp))


def fit_boosted(train: DataFrame, pre: Preprocessor, label: str, params: dict, weight: str | None = "weight",
                validation_col: str | None = None, tol: float = 0.01, seed: int = 42):
    """M7: multi-class boosted trees as one binary GBT per class with class
    weights; with ``validation_col`` (true on validation rows, e.g. the
    split's 'val' part) each GBT stops early when the validation loss stops
    improving by ``tol`` (``validationIndicatorCol`` / ``validationTol``).
    Returns (model, labels, loss history): the history has one row per
    class and iteration with the training and validation log-loss
    (``evaluateEachIteration``; one aggregate per class, not per tree)."""
    keep = [label] + ([weight] if weight else []) + ([validation_col] if validation_col else [])
    x = pre.transform(train, keep=keep)
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc").fit(x)
    x = idx.transform(x)
    p = dict(params)
    models, history = [], []
    for i, lab in enumerate(idx.labels):
        xi = x.withColumn("__y", (F.col("label_idx") == i).cast("double"))
        gbt = GBTClassifier(featuresCol="features", labelCol="__y", maxDepth=int(p.get("max_depth", 3)),
                            maxIter=int(p.get("n_estimators", 10)), stepSize=float(p.get("learning_rate", 0.1)),
                            subsamplingRate=float(p.get("subsample", 1.0)), seed=seed,
                            minInstancesPerNode=max(1, int(float(p.get("min_child_weight", 1)))),
                            minInfoGain=float(p.get("gamma", 0.0)), **({"weightCol": weight} if weight else {}),
                            **({"validationIndicatorCol": validation_col, "validationTol": float(tol)}
                               if validation_col else {}))
        m = gbt.fit(xi)
        models.append(m)
        tr = xi.filter(~F.col(validation_col)) if validation_col else xi
        tr_loss = m.evaluateEachIteration(tr)
        va_loss = m.evaluateEachIteration(xi.filter(F.col(validation_col))) if validation_col else [None] * len(tr_loss)
        history += [(lab, it + 1, float(a), None if b is None else float(b)) for it, (a, b) in enumerate(zip(tr_loss, va_loss))]
    spark = train.sparkSession
    hist = spark.createDataFrame(history, "label string, iteration int, train_loss double, val_loss double")
    return BoostedOvR(idx, models), list(idx.labels), hist


def fallback_predictions(df: DataFrame, actual: str, keep: Sequence[str], reason: str = "no model") -> DataFrame:
    """Without a model, the recorded label stands in: source ``dataset``, no
    confidence, ``fallback`` true and the reason."""
    return df.select(*[F.col(k) for k in keep], F.col(actual).cast("string").alias("predicted"),
                     F.lit(None).cast("double").alias("confidence"), F.lit("dataset").alias("source"),
                     F.lit(True).alias("fallback"), F.lit(reason).alias("reason"))


def predict_or_fallback(spark: SparkSession, path: str, df: DataFrame, actual: str, keep: Sequence[str]) -> DataFrame:
    """The saved model's predictions, or the recorded labels where the model
    can't be loaded, or ``df`` has none of its features. Either way the same
    columns: keep, predicted, confidence, source, fallback, reason."""
    try:
        model, pre, labels = load_model(spark, path)
    except Exception as e:      # absent, partly written, or of another version
        return fallback_predictions(df, actual, keep, f"model not loaded: {type(e).__name__}")
    if not set(pre.features) & set(df.columns):
        return fallback_predictions(df, actual, keep, "no feature of the model")
    scored = predict(model, pre, df, labels, keep=keep)
    return scored.select(*keep, "predicted", "confidence", "source", F.lit(False).alias("fallback"),
                         F.lit(None).cast("string").alias("reason"))


def predict_file(spark: SparkSession, path: str, csv: str, out: str, key: str) -> DataFrame:
    """Q7: read a CSV with a header, score it with the saved model and write the
    predictions as CSV; returns count and mean confidence per predicted label.
    Every model feature is read as a number (text that is none counts as
    missing); features that the file lacks are filled like missing values."""
    from ..sources.io import read_csv, write_csv

    model, pre, labels = load_model(spark, path)
    header = spark.read.option("header", True).csv(csv).columns
    rows = read_csv(spark, csv, ", ".join(f"`{c}` string" for c in header), required=[key])
    rows = rows.select(key, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in pre.features if c in header])
    write_csv(predict(model, pre, rows, labels, keep=[key]), out)
    done = read_csv(spark, out, ", ".join([f"`{key}` string", "predicted string", "confidence double",
                                           *[f"`prob_{c}` double" for c in labels], "source string"]))
    return done.groupBy("predicted").agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("mean_confidence"))


def cross_validate(df: DataFrame, pre_features: Sequence[str], label: str, fold_col: str, k: int, family: str,
                   params: dict, weight: str | None = "weight", seed: int = 42) -> list[float]:
    """M9: per-fold accuracy; the imputer/scaler is refitted on each fold's
    training part (no leakage from the held-out fold)."""
    scores = []
    for f in range(k):
        tr, te = df.filter(F.col(fold_col) != f), df.filter(F.col(fold_col) == f)
        pre = Preprocessor.fit(tr, pre_features)
        model, labels = fit_pipeline(tr, pre, label, family, params, weight, seed=seed)
        p = model.transform(pre.transform(te, keep=[label]))
        scores.append(accuracy(p, "label_idx"))
    return scores


def run_search(spark: SparkSession, train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
               trials: Sequence[tuple[int, str, dict]], weight: str | None = "weight", parallelism: int = 4,
               seed: int = 42) -> DataFrame:
    """Evaluate sampled trials concurrently (driver threads submit
    Spark jobs); a failing trial becomes a row with success=false and its
    error, never an aborted search."""
    pre = Preprocessor.fit(train, features)

    def one(trial):
        tid, fam, params = trial
        try:
            model, _ = fit_pipeline(train, pre, label, fam, params, weight, seed=seed)
            p = model.transform(pre.transform(valid, keep=[label]))
            return (tid, fam, {k: str(v) for k, v in params.items()}, accuracy(p, "label_idx"), True, None)
        except Exception as e:  # captured per trial
            return (tid, fam, {k: str(v) for k, v in params.items()}, None, False,
                    f"{type(e).__name__}: {e}"[:500] + "\n" + traceback.format_exc(limit=1)[-300:])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(one, trials))
    return spark.createDataFrame(rows, "trial_id int, family string, params map<string,string>, score double, "
                                       "success boolean, error string")


def model_summary(spark: SparkSession, model: PipelineModel, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row describing the fitted model."""
    est = model.stages[-1]
    trees = getattr(est, "getNumTrees", None)
    n_trees = est.getNumTrees if isinstance(trees, int) else (trees() if callable(trees) else None)
    if n_trees is None and hasattr(est, "models"):
        n_trees = sum(getattr(m, "getNumTrees", 0) for m in est.models)
    params = {p.name: str(v) for p, v in est.extractParamMap().items()
              if p.name in ("maxDepth", "maxIter", "numTrees", "stepSize", "regParam", "subsamplingRate")}
    return spark.createDataFrame([(type(est).__name__, len(features), len(labels), n_trees, params)],
                                 "model string, n_features int, n_classes int, n_trees int, params map<string,string>")


def feature_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per feature (OneVsRest: mean over the class models)."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        imp = est.featureImportances.toArray().tolist()
    elif hasattr(est, "models"):
        arrs = [m.featureImportances.toArray() for m in est.models if hasattr(m, "featureImportances")]
        imp = (sum(arrs) / len(arrs)).tolist() if arrs else [0.0] * len(features)
    else:
        raise ValueError("model has no feature importances")
    return spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(zip(features, imp))],
                                 "pos int, feature string, importance double")


def save_model(model: PipelineModel, pre: Preprocessor, labels: Sequence[str], path: str) -> None:
    """K8: pipeline (with label indexer) + preprocessor + labels under one folder."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(pre.to_json(), json.dumps(list(labels)))], "preprocessor string, labels string") \
         .coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    model = PipelineModel.load(f"{path}/pipeline")
    meta = spark.read.json(f"{path}/meta").first()
    return model, Preprocessor.from_json(meta["preprocessor"]), json.loads(meta["labels"])


# ---------------------------------------------------------------- M15/M17/M19/M20
def score_record(spark: SparkSession, record: dict, model: PipelineModel, pre: Preprocessor,
                 labels: Sequence[str]) -> DataFrame:
    """One record scored by the same code path as a batch (M14); absent
    features are filled like any batch row (quirk 9: one missing policy)."""
    present = {k: (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
               for k, v in record.items()}
    schema = ", ".join(f"`{k}` double" if isinstance(v, float) else f"`{k}` string" for k, v in present.items())
    row = spark.createDataFrame([tuple(present.values())], schema)
    return predict(model, pre, row, labels, keep=[k for k in present if k not in pre.features])


def union_for_retrain(existing: DataFrame, uploaded: DataFrame, scored: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables by column name (missing columns null),
    minus scored-output columns (quirk 10 leak guard)."""
    u = existing.unionByName(uploaded, allowMissingColumns=True)
    return u.select(*leak_guard(u.columns, scored))


def retrain(existing: DataFrame, uploaded: DataFrame, features: Sequence[str], label: str, key: str,
            family: str = "gradient_boosting", params: dict | None = None, seed: int = 42, scored: Sequence[str] = ()):
    """Union, split (exact stratified, M4), weights (A22), fit (M6/M7)
    on train and validation rows, report on test. Returns (model, preprocessor, labels, report)."""
    from .evaluate import classification_report
    from .split import stratified_split, with_weights

    d = union_for_retrain(existing, uploaded, scored)
    feats = [f for f in leak_guard(features, scored) if f in d.columns]
    s = with_weights(stratified_split(d, label, [key], seed=seed), label)
    train, test = s.filter(F.col("split").isin("train", "val")), s.filter(F.col("split") == "test")
    pre = Preprocessor.fit(train, feats)
    model, labels = fit_pipeline(train, pre, label, family, params or {}, seed=seed)
    rep = classification_report(predict(model, pre, test, labels, keep=[label]), label, "predicted")
    return model, pre, labels, rep


def plot_data(spark: SparkSession, scored: DataFrame, actual: str, predicted: str, model: PipelineModel | None = None,
              features: Sequence[str] = (), scores: Sequence[float] = ()) -> dict[str, DataFrame]:
    """The data behind the reference's charts, as tidy tables (no
    pictures): confusion, class distribution, confidence histogram,
    per-class recall, feature importance top 15, CV scores."""
    from .aggregates import value_counts, width_histogram
    from .evaluate import agreement, confusion_long

    out = {"confusion": confusion_long(scored, actual, predicted),
           "class_distribution": value_counts(scored, actual, normalize=True),
           "per_class": agreement(scored, actual, predicted)}
    if "confidence" in scored.columns:
        out["confidence_histogram"] = width_histogram(scored, "confidence", 20)
    if model is not None and features:
        out["importance"] = feature_importances(spark, model, features).orderBy(F.desc("importance"), "pos").limit(15)
    if scores:
        out["cv_scores"] = spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(scores)], "fold int, score double")
    return out


def model_status(spark: SparkSession, registry_folder: str) -> DataFrame:
    """Newest complete run in an artefact folder."""
    from ..sources.artefacts import latest_complete_run, listing

    return latest_complete_run(listing(spark, registry_folder))
