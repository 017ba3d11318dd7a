"""Training / evaluation / search / scoring composites on ``embeddings``
(64-d vectors, labels 0-9). Not SQL-expressible: rows-only checks plus the
invariant tests in tests/.

The vector column is unpacked into named numeric features so the same
preparation code serves wide catalogue tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..operators import boost as B
from ..operators import evaluate as E
from ..operators import learn as L
from ..operators import one_pass as OP
from ..operators import ordering as O
from ..operators import split as S
from ..operators import trees as TR
from ..operators.partitioning import materialize, spread
from ..session import scratch_path
from ..sources import io as IO
from ..sources.tables import Tables

N_DIMS = 64
FEATURES = [f"f{i:02d}" for i in range(N_DIMS)]


def feature_table(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(FEATURES[i]) for i in range(N_DIMS)])


def split_table(t: Tables) -> DataFrame:
    """Split + weights, written once to the shared folder: training reads it
    many times (statistics, tree levels)."""
    s = S.stratified_split(feature_table(t), "label", ["vec_id"], test=0.2, val=0.1, seed=42)
    return spread(materialize(S.with_weights(s, "label"), "split"))


def _fit(t: Tables, family: str = "random_forest", params: dict | None = None):
    d = split_table(t)
    train = d.filter(F.col("split").isin("train", "val"))     # no setting is tuned here, so the fit takes both
    pre = L.Preprocessor.fit(train, FEATURES)
    model, labels = L.fit_pipeline(train, pre, "label", family, params or {"n_estimators": 20, "max_depth": 6})
    return d, pre, model, labels


def nb_scores(t: Tables) -> DataFrame:
    """M4, M6, M10 and M14 with a Gaussian naive Bayes model: label and
    confidence of every test row."""
    d = split_table(t)
    train = d.filter(F.col("split").isin("train", "val"))
    pre = L.Preprocessor.fit(train, FEATURES)
    model, labels = L.fit_pipeline(train, pre, "label", "naive_bayes", {}, weight=None)
    return L.predict(model, pre, d.filter(F.col("split") == "test"), labels, keep=["vec_id", "label"])


def nb_predictions(t: Tables) -> DataFrame:
    return nb_scores(t).select("vec_id", "label", "predicted", F.round("confidence", 5).alias("confidence"))


def _saved_nb(t: Tables) -> tuple[DataFrame, str]:
    """The test part, and the folder of a naive Bayes model of the rest."""
    d, path = split_table(t), scratch_path(t.spark, "model")
    train = d.filter(F.col("split").isin("train", "val"))
    pre = L.Preprocessor.fit(train, FEATURES)
    model, labels = L.fit_pipeline(train, pre, "label", "naive_bayes", {}, weight=None)
    L.save_model(model, pre, labels, path)
    return d.filter(F.col("split") == "test"), path


def predict_file(t: Tables) -> DataFrame:
    """K8 + Q7: the test part as a CSV file, scored by a saved model into another."""
    test, path = _saved_nb(t)
    csv, out = scratch_path(t.spark, "csv"), scratch_path(t.spark, "csv")
    IO.write_csv(test.select("vec_id", *FEATURES), csv)
    s = L.predict_file(t.spark, path, csv, out, "vec_id")
    return s.select("predicted", "count", F.round("mean_confidence", 5).alias("mean_confidence"))


def predict_fallback(t: Tables) -> DataFrame:
    """The test part by a saved model, by a folder without one, and without
    any feature."""
    test, path = _saved_nb(t)
    cases = [("model", path, test), ("absent", scratch_path(t.spark, "model"), test), ("columns", path, test.select("vec_id", "label"))]
    parts = [L.predict_or_fallback(t.spark, at, rows, "label", ["vec_id"]).withColumn("case", F.lit(name)) for name, at, rows in cases]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("case", "vec_id", "predicted", "source", "fallback", F.col("confidence").isNull().alias("unsure"))


def nb_report(t: Tables) -> DataFrame:
    """A24 of those predictions."""
    return E.classification_report(nb_scores(t), "label", "predicted", digits=6)


def nb_fold_scores(t: Tables) -> DataFrame:
    """M5 + M9: accuracy of each of five stratified folds."""
    f = materialize(S.stratified_folds(feature_table(t), "label", ["vec_id"], k=5, seed=42), "folds")
    scores = L.cross_validate(f, FEATURES, "label", "fold", 5, "naive_bayes", {}, weight=None)
    return t.spark.createDataFrame([(i, round(s, 9)) for i, s in enumerate(scores)], "fold int, score double")


def _fold_metrics(t: Tables) -> DataFrame:
    f = materialize(S.stratified_folds(feature_table(t), "label", ["vec_id"], k=5, seed=42), "folds")
    return OP.fold_metrics(OP.out_of_fold(f, FEATURES, "label", "fold"))


def cv_metrics(t: Tables) -> DataFrame:
    """M5 + M9: metrics of each of five stratified folds and two families, all
    fitted from one aggregate."""
    m = _fold_metrics(t)
    return m.select("family", "fold", "n", *[round_half_up(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def cv_leaderboard(t: Tables) -> DataFrame:
    """The families by mean accuracy over the folds."""
    b = OP.leaderboard(_fold_metrics(t))
    return b.select("rank", "family", "n_folds", *[round_half_up(c, 6).alias(c) for c in ("cv_mean", "cv_std", "precision", "recall", "f1")])


def group_split(t: Tables) -> DataFrame:
    """M4 with whole groups: a customer's orders all go to one part, parts
    alike in their order states."""
    s = S.stratified_group_split(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", "o_custkey")
    return s.select("o_orderkey", "o_custkey", "split")


def group_folds(t: Tables) -> DataFrame:
    """M5 with whole groups: rows per fold, order state and customers."""
    f = S.stratified_group_folds(t.orders.select("o_custkey", "o_orderstatus"), "o_orderstatus", "o_custkey", k=5)
    return f.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


def train_evaluate(t: Tables) -> DataFrame:
    """M4 -> A22 -> M6 -> M7 -> M14 -> A24 on the test part."""
    d, pre, model, labels = _fit(t)
    test = d.filter(F.col("split") == "test")
    pred = L.predict(model, pre, test, labels, keep=["vec_id", "label"])
    return E.classification_report(pred, "label", "predicted", digits=6)


def confusion_test(t: Tables) -> DataFrame:
    d, pre, model, labels = _fit(t)
    pred = L.predict(model, pre, d.filter(F.col("split") == "test"), labels, keep=["vec_id", "label"])
    return E.confusion_long(pred, "label", "predicted")


def cv_scores(t: Tables) -> DataFrame:
    """M5 + M9 + A25: 5-fold stratified CV accuracy of logistic regression."""
    f = S.stratified_folds(feature_table(t), "label", ["vec_id"], k=5, seed=42)
    f = spread(materialize(S.with_weights(f, "label"), "folds"))
    scores = L.cross_validate(f, FEATURES, "label", "fold", 5, "logistic_regression", {"max_iter": 50})
    return E.score_summary(t.spark, scores).select("mean", "std", F.size("folds").alias("n_folds"))


def model_search(t: Tables) -> DataFrame:
    """Seeded random search over several families, leaderboard with
    rank numbers (O4) ordered by validation accuracy."""
    d = split_table(t)
    train, valid = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "val")
    trials = L.sample_trials(["logistic_regression", "decision_tree", "random_forest", "naive_bayes"], 2, seed=42)
    res = L.run_search(t.spark, train, valid, FEATURES, "label", trials, parallelism=4)
    ok = res.filter("success")
    board = O.rank_numbers(ok, "score", tie=["trial_id"], desc=True)
    return board.select("rank", "trial_id", "family", F.round("score", 6).alias("score"))


def family_leaderboard(t: Tables) -> DataFrame:
    """Per-family mean / max / count / sample std of scores."""
    d = split_table(t)
    train, valid = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "val")
    trials = L.sample_trials(["logistic_regression", "decision_tree"], 2, seed=7)
    res = L.run_search(t.spark, train, valid, FEATURES, "label", trials, parallelism=4).filter("success")
    from ..operators.aggregates import grouped_summary
    return grouped_summary(res, "family", "score")


def batch_scores(t: Tables) -> DataFrame:
    """M14 on every row + Q7 summary: predicted counts and mean confidence."""
    d, pre, model, labels = _fit(t)
    pred = L.predict(model, pre, d, labels, keep=["vec_id", "label"])
    return pred.groupBy("predicted").agg(F.count(F.lit(1)).alias("count"),
                                         F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def feature_importance(t: Tables) -> DataFrame:
    """M13 + O5: importances sorted with running share."""
    d, pre, model, labels = _fit(t)
    imp = L.feature_importances(t.spark, model, FEATURES)
    c = O.cumulative_share(imp, "importance", "feature")
    return c.select("position", "feature", F.round("importance", 6).alias("importance"),
                    F.round("share", 6).alias("share")).orderBy("position").limit(20)


def tree_metrics(t: Tables) -> DataFrame:
    """Structure summary of the fitted forest, read back from its
    saved node table (a folder under the shared checkpoint location)."""
    d, pre, model, labels = _fit(t)
    path = scratch_path(t.spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    nodes = TR.node_table(t.spark, path)
    return TR.tree_summary(TR.tree_metrics(nodes))


def split_usage(t: Tables) -> DataFrame:
    """Split count per feature, top 10."""
    d, pre, model, labels = _fit(t)
    path = scratch_path(t.spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    return TR.split_counts(TR.node_table(t.spark, path), FEATURES, top=10)


def boosted_history(t: Tables) -> DataFrame:
    """M7: one-vs-rest boosted trees with class weights, early stopping on
    the split's validation rows, and the per-class loss history (training
    and validation log-loss per iteration)."""
    d = split_table(t)
    fit_rows = d.filter(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
    pre = L.Preprocessor.fit(fit_rows.filter(~F.col("is_val")), FEATURES)
    _, _, hist = L.fit_boosted(fit_rows, pre, "label", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3},
                               validation_col="is_val", tol=0.01)
    return hist.select("label", "iteration", F.round("train_loss", 6).alias("train_loss"),
                       F.round("val_loss", 6).alias("val_loss"))


BOOST = B.BoostParams(n_estimators=30, max_depth=3, learning_rate=0.2, subsample=0.8, colsample=0.8, min_child_weight=1.0,
                      gamma=0.01, reg_alpha=0.05, reg_lambda=1.0, bins=64, patience=3)


def softmax_boost(t: Tables) -> DataFrame:
    """Softmax boosting with the caller's parameters; the
    losses of every round, and the best round with its model's accuracy on
    the test part."""
    d = split_table(t)
    rows = d.filter(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
    model, history = B.fit(rows, FEATURES, "label", ["vec_id"], BOOST, weight="weight", validation="is_val")
    accuracy = L.accuracy(B.predict(model, d.filter(F.col("split") == "test"), keep=["label"]), "label", "predicted")
    table = [(i, round(a, 6), None if b is None else round(b, 6), i == model.best, round(accuracy, 6) if i == model.best else None)
             for i, a, b in history]
    return t.spark.createDataFrame(table, "iteration int, train_loss double, val_loss double, best boolean, test_accuracy double")
