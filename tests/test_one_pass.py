"""One-scan cross-validation against a fit per fold; group splits by their laws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import learn as L
from tabsieve.operators import one_pass as OP
from tabsieve.operators import split as S

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + np.eye(3)[y] * 1.2 + 50.0
    pdf = pd.DataFrame(x, columns=FEATURES).assign(key=range(n), y=[f"class {v}" for v in y], fold=np.arange(n) % 4)
    return spark.createDataFrame(pdf).checkpoint()


def test_equals_a_fit_per_fold(rows):
    got = {(r["family"], r["fold"]): r for r in OP.fold_metrics(OP.out_of_fold(rows, FEATURES, "y", "fold", ["key"])).collect()}
    loop = L.cross_validate(rows, FEATURES, "y", "fold", 4, "naive_bayes", {}, weight=None)
    assert [got["naive_bayes", f]["accuracy"] for f in range(4)] == pytest.approx(loop, abs=1e-12)
    assert all(r["recall"] == pytest.approx(r["accuracy"]) for r in got.values())


def test_pooled_variance_by_hand(rows):
    pdf = rows.toPandas()
    models = OP.fold_models(rows, FEATURES, "y", "fold", ["discriminant"])
    for f in range(4):
        tr, m = pdf[pdf["fold"] != f], models["discriminant", f]
        centred = tr[FEATURES] - tr.groupby("y")[FEATURES].transform("mean")
        assert m.var[0] == pytest.approx((centred ** 2).mean().to_numpy(), rel=1e-9)
        assert m.mean == pytest.approx(tr.groupby("y")[FEATURES].mean().to_numpy(), rel=1e-12)


def test_missing_values_unseen_classes_and_constants(spark):
    data = [(0, "p", 1.0, None, 7.0), (1, "p", 1.5, 2.0, 7.0), (2, "p", float("nan"), 2.5, 7.0),
            (0, "q", 9.0, None, 7.0), (1, "q", 9.5, None, 7.0), (2, "q", 8.0, None, 7.0),
            (0, "once", 4.0, 4.0, 7.0), (1, None, 1.0, 1.0, 7.0), (None, "p", 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(data, "fold int, y string, a double, b double, c double")
    got = OP.out_of_fold(df, FEATURES, "y", "fold", families=["naive_bayes"]).collect()
    assert len(got) == 7                                        # rows without a label or a fold are out
    assert "once" not in {r["predicted"] for r in got if r["fold"] == 0}
    assert {r["predicted"] for r in got if r["actual"] == "q"} == {"q"}
    assert OP.out_of_fold(df.filter("fold = 1"), FEATURES, "y", "fold").count() == 0
    assert OP.out_of_fold(df.limit(0), FEATURES, "y", "fold").count() == 0


def test_too_many_classes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(OP, "MAX_GROUPS", 50)
    df = spark.range(100).select(F.col("id").cast("string").alias("y"), (F.col("id") % 2).alias("fold"), F.col("id").alias("a"))
    with pytest.raises(ValueError, match="pairs of fold and class"):
        OP.fold_models(df, ["a"], "y", "fold")


def test_statistics_are_one_scan(rows):
    plan = OP.fold_statistics(rows, FEATURES, "y", "fold")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("Exchange") == 1


# ---------------------------------------------------------------- whole groups
@pytest.fixture(scope="module")
def grouped(spark):
    """400 groups of 1 to 40 rows; labels mostly one per group."""
    rng = np.random.default_rng(11)
    data = []
    for g in range(400):
        own = "xyz"[rng.integers(0, 3)]
        data += [(f"g{g}", own if rng.random() < 0.9 else "xyz"[rng.integers(0, 3)]) for _ in range(int(rng.integers(1, 41)))]
    return spark.createDataFrame(data, "grp string, y string").checkpoint()


def test_no_group_in_two_parts_and_shares_within_a_group(grouped):
    s = S.stratified_group_split(grouped, "y", "grp", test=0.2, val=0.1).toPandas()
    assert len(s) == grouped.count() and s["split"].notna().all()
    assert (s.groupby("grp")["split"].nunique() == 1).all()
    largest = s.groupby("grp").size().max()
    for part, share in (("test", 0.2), ("val", 0.1), ("train", 0.7)):
        for label in "xyz":
            n = (s["y"] == label).sum()
            assert abs(((s["y"] == label) & (s["split"] == part)).sum() - share * n) <= largest, (part, label)


@pytest.mark.parametrize("digits", [1, 3])
def test_dealing_does_not_depend_on_the_cells(grouped, digits, monkeypatch):
    base = S.stratified_group_folds(grouped, "y", "grp", k=5).select("grp", "fold").distinct().toPandas()
    monkeypatch.setattr(S, "prefix_digits", lambda df: digits)
    other = S.stratified_group_folds(grouped, "y", "grp", k=5).select("grp", "fold").distinct().toPandas()
    assert dict(base.to_numpy()) == dict(other.to_numpy())
    assert set(base["fold"]) == {0, 1, 2, 3, 4}


def test_null_groups_null_labels_and_a_hot_group(spark):
    data = [("hot", "x")] * 300 + [(None, "x")] * 20 + [(f"n{i}", None) for i in range(40)] + [(f"s{i}", "x") for i in range(300)]
    s = S.stratified_group_split(spark.createDataFrame(data, "grp string, y string"), "y", "grp").toPandas()
    assert len(s) == len(data) and s["split"].notna().all()
    assert s[s["grp"].isna()]["split"].nunique() == 1 and s[s["grp"] == "hot"]["split"].nunique() == 1
    assert abs((s[s["y"].isna()]["split"] == "test").sum() - 8) <= 1     # dealt among their like
    assert S.stratified_group_split(spark.createDataFrame([], "grp string, y string"), "y", "grp").count() == 0
