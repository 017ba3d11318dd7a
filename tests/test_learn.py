"""Learning path invariants: preprocessing, probabilities, single-record
scoring through the batch path, retrain on a union, model save/load."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import learn as L
from tabsieve.operators.split import stratified_split, with_weights

FEATS = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def frame(tables_mid):
    e = tables_mid.embeddings.filter(F.col("label") < 3)
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(FEATS[i]) for i in range(8)]).cache()


def test_preprocessor_standardises(frame):
    pre = L.Preprocessor.fit(frame, FEATS)
    x = pre.transform(frame, keep=["label"])
    means = frame.select(*pre.columns(frame)).agg(*[F.avg(c).alias(c) for c in FEATS]).first()
    assert all(abs(means[c]) < 1e-9 for c in FEATS)
    assert x.count() == frame.count()


def test_imputed_moments_match_a_direct_pass(frame):
    # holes in some columns: the scaler's moments are those of the filled column
    holed = frame.select("label", *[F.when(F.col("vec_id") % (i + 2) != 0, F.col(c)).alias(c)
                                    for i, c in enumerate(FEATS)])
    pre = L.Preprocessor.fit(holed, FEATS)
    filled = [F.coalesce(F.col(c), F.lit(pre.medians[c])) for c in FEATS]
    want = holed.agg(*[F.mean(x).alias(f"m{i}") for i, x in enumerate(filled)],
                     *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
    for i, c in enumerate(FEATS):
        assert abs(pre.means[c] - want[f"m{i}"]) < 1e-9 * max(1.0, abs(want[f"m{i}"]))
        assert abs(pre.stds[c] - want[f"s{i}"]) < 1e-9 * max(1.0, want[f"s{i}"])
    stds = holed.select(*pre.columns(holed)).agg(*[F.stddev_pop(c).alias(c) for c in FEATS]).first()
    assert all(abs(stds[c] - 1.0) < 1e-9 for c in FEATS)


def test_ovr_probabilities_sum_to_one_and_record_path(spark, frame):
    s = with_weights(stratified_split(frame, "label", ["vec_id"]), "label")
    train = s.filter(F.col("split") == "train")
    pre = L.Preprocessor.fit(train, FEATS)
    model, labels = L.fit_pipeline(train, pre, "label", "gradient_boosting", {"n_estimators": 3, "max_depth": 2})
    pred = L.predict(model, pre, s.filter(F.col("split") == "test"), labels, keep=["vec_id", "label"])
    tot = pred.select((sum(F.col(f"prob_{c}") for c in labels)).alias("t"), "confidence").collect()
    assert all(abs(r["t"] - 1.0) < 1e-9 and 0 < r["confidence"] <= 1 for r in tot)
    rec = L.score_record(spark, {"f0": 0.1, "f3": -0.2}, model, pre, labels).collect()
    assert len(rec) == 1 and rec[0]["predicted"] in labels
    path = tempfile.mkdtemp(prefix="tabsieve-model-", dir="/tmp")
    L.save_model(model, pre, labels, path)
    m2, pre2, labels2 = L.load_model(spark, path)
    again = L.predict(m2, pre2, s.filter(F.col("split") == "test"), labels2, keep=["vec_id"])
    assert again.count() == pred.count() and labels2 == labels


def test_retrain_on_union_drops_leaks(spark, frame):
    scored = frame.withColumn("prob_0", F.lit(0.5)).withColumn("confidence", F.lit(0.9))
    model, pre, labels, rep = L.retrain(scored, frame, FEATS + ["prob_0", "confidence"], "label", "vec_id",
                                        family="logistic_regression", params={"max_iter": 10})
    assert "prob_0" not in pre.features and "confidence" not in pre.features
    assert {r["label"] for r in rep.collect()} >= {"accuracy", "macro avg", "weighted avg"}


def test_search_captures_failures(spark, frame):
    s = with_weights(stratified_split(frame, "label", ["vec_id"]), "label")
    trials = [(0, "decision_tree", {"max_depth": 3}), (1, "no_such_family", {})]
    res = {r["trial_id"]: r for r in L.run_search(spark, s.filter("split = 'train'"), s.filter("split = 'val'"),
                                                   FEATS, "label", trials, parallelism=2).collect()}
    assert res[0]["success"] and res[0]["score"] is not None
    assert not res[1]["success"] and "unknown family" in res[1]["error"]


def test_boosted_ovr_early_stopping_history_and_scoring(frame):
    s = with_weights(stratified_split(frame, "label", ["vec_id"]), "label")
    fit_rows = s.filter(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
    pre = L.Preprocessor.fit(fit_rows.filter(~F.col("is_val")), FEATS)
    model, labels, hist = L.fit_boosted(fit_rows, pre, "label", {"n_estimators": 8, "max_depth": 2},
                                        validation_col="is_val", tol=0.01)
    h = hist.toPandas()
    assert set(h["label"]) == set(labels) and h["val_loss"].notna().all()
    # every class model has as many iterations as trees, at most the requested 8
    for lab, g in h.groupby("label"):
        assert list(g["iteration"]) == list(range(1, len(g) + 1)) and len(g) <= 8
    assert len(model.models) == len(labels)
    pred = L.predict(model, pre, s.filter(F.col("split") == "test"), labels, keep=["vec_id", "label"]).toPandas()
    probs = pred[[f"prob_{lab}" for lab in labels]].sum(axis=1)
    assert (abs(probs - 1.0) < 1e-9).all() and set(pred["predicted"]) <= set(labels)
    assert (pred["confidence"] == pred[[f"prob_{lab}" for lab in labels]].max(axis=1)).all()
    imp = L.feature_importances(frame.sparkSession, model, FEATS).toPandas()
    assert len(imp) == len(FEATS)
