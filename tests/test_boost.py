"""Histogram boosting: splits against a direct search over all rows, losses
against a direct computation, stopping, parameters and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import boost as B

FEATS = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def frame(tables_small):
    e = tables_small.embeddings
    v = [F.when(F.col("vec_id") % (7 + i) != 0, F.col("embedding")[i].cast("double")).alias(FEATS[i]) for i in range(5)]
    return e.select("vec_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("label"),
                    (F.col("vec_id") % 4 == 0).alias("is_val"), (1 + F.col("vec_id") % 2).alias("w"), *v).cache()


def direct_split(x, g, h, par):
    """The best gain over every feature, cut and side of absent values."""
    def s(rows):
        soft = max(abs(g[rows].sum()) - par.reg_alpha, 0)
        return soft * soft / (h[rows].sum() + par.reg_lambda)
    best, every = 0.0, np.ones(len(x), bool)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f]):
            for absent in (True, False):
                left = np.where(x[:, f] == B.MISSING, absent, x[:, f] <= cut)
                if left.all() or not left.any() or min(h[left].sum(), h[~left].sum()) < par.min_child_weight:
                    continue
                best = max(best, (s(left) + s(~left) - s(every)) / 2 - par.gamma)
    return best


@pytest.mark.parametrize("par", [B.BoostParams(n_estimators=2, max_depth=2, bins=16),
                                 B.BoostParams(n_estimators=2, max_depth=2, bins=16, reg_alpha=0.5, reg_lambda=3.0, gamma=0.05, min_child_weight=4.0)])
def test_every_split_is_the_best_one(frame, par):
    model, history = B.fit(frame, FEATS, "label", ["vec_id"], par, weight="w")
    pdf = frame.toPandas()
    x = B.binned(pdf[FEATS].to_numpy(dtype=float), model.borders)
    y, w = pdf["label"].map({c: i for i, c in enumerate(model.labels)}).to_numpy(), pdf["w"].to_numpy(dtype=float)
    assert model.labels == ["c0", "c1", "c2"] and (x == B.MISSING).any()
    for r, trees in enumerate(model.rounds):
        prob = B.softmax(model.margins(x, r))
        for c, tree in enumerate(trees):
            g, h = w * (prob[:, c] - (y == c)), w * prob[:, c] * (1 - prob[:, c])
            for node in range(3):                             # the root and its children
                rows = np.ones(len(x), bool) if node == 0 else None
                if node and tree.feature[0] < 0:
                    continue
                if node:
                    b = x[:, tree.feature[0]]
                    left = np.where(b == B.MISSING, tree.absent_left[0], b <= tree.cut[0])
                    rows = left if node == 1 else ~left
                want = direct_split(x[rows], g[rows], h[rows], par)
                assert tree.gain[node] == pytest.approx(want, abs=1e-7)
                if tree.feature[node] < 0:
                    soft = np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - par.reg_alpha, 0)
                    assert tree.value[node] == pytest.approx(-par.learning_rate * soft / (h[rows].sum() + par.reg_lambda), abs=1e-7)
        prob = B.softmax(model.margins(x, r + 1))
        assert history[r][1] == pytest.approx(float(np.average(-np.log(prob[np.arange(len(y)), y]), weights=w)), abs=1e-9)
        assert history[r][2] is None


def test_stops_by_rounds_and_keeps_the_best(frame, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)                      # margins are written along the way
    par = B.BoostParams(n_estimators=12, max_depth=3, learning_rate=1.0, patience=2, bins=16, subsample=0.7, colsample=0.6)
    model, history = B.fit(frame, FEATS, "label", ["vec_id"], par, validation="is_val")
    val = [h[2] for h in history]
    assert model.best == 1 + int(np.argmin(val))
    assert len(history) == 12 or len(history) == model.best + 2
    pdf = frame.filter("is_val").toPandas()
    x, y = B.binned(pdf[FEATS].to_numpy(dtype=float), model.borders), pdf["label"].map(model.labels.index).to_numpy()
    for i, _, loss in history:
        prob = B.softmax(model.margins(x, i))
        assert loss == pytest.approx(float(-np.log(prob[np.arange(len(y)), y]).mean()), abs=1e-9)
    again = B.BoostedModel.from_json(model.to_json())
    a, b = (B.predict(m, frame, ["vec_id"]).orderBy("vec_id").toPandas() for m in (model, again))
    assert a.equals(b) and set(a["predicted"]) <= set(model.labels)
    assert np.allclose(a[[f"prob_{c}" for c in model.labels]].sum(axis=1), 1)
    assert sum(s for _, s, _ in model.importances()) == pytest.approx(1.0)


def test_edges(spark, frame):
    one, history = B.fit(frame.withColumn("label", F.lit("only")), FEATS, "label", ["vec_id"])
    assert history == [] and B.predict(one, frame, ["vec_id"]).first()["predicted"] == "only"
    none, _ = B.fit(frame.limit(0), FEATS, "label", ["vec_id"])
    assert B.predict(none, frame, ["vec_id"]).first()["predicted"] is None
    rows = [(i, "ab"[i % 2] if i % 5 else None, float("nan") if i % 3 == 0 else float(i % 2), None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string, x double, void double")
    model, history = B.fit(df, ["x", "void"], "label", ["id"], B.BoostParams(n_estimators=2, max_depth=1, min_child_weight=0.0))
    assert model.labels == ["a", "b"] and history[1][1] < history[0][1] < np.log(2)
    assert B.predict(model, df.drop("void"), ["id"]).count() == 40
    with pytest.raises(ValueError):
        B.BoostParams(subsample=0.0)
