"""Invariants of splits, weights, evaluation, correlation and the golden
confusion-matrix report."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import evaluate as E
from tabsieve.operators import split as S
from tabsieve.operators.correlation import correlation_pairs
from tabsieve.operators.profile import select_features


def test_split_parts_are_disjoint_and_sized(tables_mid):
    li = tables_mid.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    s = S.stratified_split(li, "l_returnflag", ["l_orderkey", "l_linenumber"], test=0.2, val=0.1).cache()
    assert s.count() == li.count()
    for r in s.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"),
                                           F.max("rank").alias("mx"), F.min("rank").alias("mn"),
                                           F.count_distinct("rank").alias("nd")).collect():
        assert r["mn"] == 1 and r["mx"] == r["n"] == r["nd"]   # ranks are a permutation
        assert r["t"] == math.floor(r["n"] * 0.2 + 0.5)


def test_folds_differ_by_at_most_one(tables_mid):
    li = tables_mid.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    f = S.stratified_folds(li, "l_returnflag", ["l_orderkey", "l_linenumber"], k=5)
    sizes = f.groupBy("l_returnflag", "fold").count().toPandas()
    for _, g in sizes.groupby("l_returnflag"):
        assert len(g) == 5 and g["count"].max() - g["count"].min() <= 1


def test_class_weights_sum_to_n(tables_mid):
    w = S.class_weights(tables_mid.lineitem, "l_returnflag").toPandas()
    assert abs((w["weight"] * w["count"]).sum() - w["count"].sum()) < 1e-6


GOLDEN_MATRIX = [[321, 0, 75], [12, 10484, 4], [127, 0, 841]]
GOLDEN_CLASSES = ["CANDIDATE", "CONFIRMED", "FALSE POSITIVE"]
# The saved report of the reference run (precision, recall, f1, support).
GOLDEN_REPORT = {
    "CANDIDATE": (0.6978260869565217, 0.8106060606060606, 0.75, 396),
    "CONFIRMED": (1.0, 0.9984761904761905, 0.9992375142966069, 10500),
    "FALSE POSITIVE": (0.9141304347826087, 0.868801652892562, 0.8908898305084746, 968),
    "accuracy": (0.9816250842886042, 0.9816250842886042, 0.9816250842886042, 11864),
    "macro avg": (0.8706521739130434, 0.8926279679916043, 0.8800424482683605, 11864),
    "weighted avg": (0.9829077369609194, 0.9816250842886042, 0.982078157117884, 11864),
}


def test_golden_confusion_matrix_reproduces_saved_report(spark):
    rep = {r["label"]: r for r in E.report_from_matrix(spark, GOLDEN_MATRIX, GOLDEN_CLASSES).collect()}
    for label, (p, r, f1, n) in GOLDEN_REPORT.items():
        got = rep[label]
        assert got["precision"] == pytest.approx(p, abs=1e-12)
        assert got["recall"] == pytest.approx(r, abs=1e-12)
        assert got["f1"] == pytest.approx(f1, abs=1e-12)
        assert got["support"] == n


def test_confusion_total_equals_support(tables_small):
    from tabsieve.plans import tabular as T

    m = T.confusion(tables_small).toPandas()
    rep = T.class_report(tables_small).toPandas().set_index("label")
    assert m[["FILLED", "OPEN", "PARTIAL_FILL"]].to_numpy().sum() == rep.loc["accuracy", "support"]


def test_correlation_agrees_with_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 15))
    x[:, 3] = x[:, 2] * 2 + rng.normal(scale=0.01, size=3000)
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(15)])
    df = spark.createDataFrame(pdf)                      # NaN stays NaN: it counts as null
    cols = list(pdf.columns)
    gram = {(r["i"], r["j"]): r["r"] for r in correlation_pairs(df, cols).collect()}
    ref = pdf.corr()
    for (i, j), v in gram.items():
        assert v == pytest.approx(ref.iloc[i, j], abs=1e-9)


def test_selection_rule_matches_pandas_rule(spark):
    rng = np.random.default_rng(1)
    n = 2000
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": a * 3 + rng.normal(scale=1e-3, size=n), "c": rng.normal(size=n),
                        "d": np.where(rng.random(n) < 0.7, np.nan, 1.0), "e": np.ones(n),
                        "f": -a + rng.normal(scale=1e-3, size=n)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    got = {r["column"]: r["reason"] for r in select_features(df, list(pdf.columns)).collect()}
    # reference rule in pandas
    feats = pdf.loc[:, pdf.isnull().mean() <= 0.5]
    var = feats.var()
    feats = feats.drop(columns=var[var == 0].index)
    corr = feats.fillna(feats.median()).corr().abs()
    upper = corr.where(np.triu(np.ones(corr.shape), k=1).astype(bool))
    drop = [c for c in upper.columns if any(upper[c] > 0.95)]
    assert got == {"a": None, "b": "correlated", "c": None, "d": "missing", "e": "zero_variance", "f": "correlated"}
    assert sorted(c for c, r in got.items() if r == "correlated") == sorted(drop)


def test_one_nan_does_not_drop_a_column(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 2))
    x[3, 1] = np.nan
    got = select_features(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"]).collect()
    assert [r["reason"] for r in got] == [None, None]


def test_rows_without_a_label_keep_a_part(spark):
    from tabsieve.operators import split as S

    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(30)], "k long, y string")
    got = S.stratified_split(df, "y", ["k"]).collect()
    assert len(got) == 30 and {r["split"] for r in got if r["y"] is None} == {S.UNLABELLED}
    assert all(r["rank"] is None for r in got if r["y"] is None)
    folds = S.stratified_folds(df, "y", ["k"]).collect()
    assert len(folds) == 30 and all((r["fold"] is None) == (r["y"] is None) for r in folds)


def test_report_with_many_classes(tables_mid):
    from pyspark.sql import functions as F
    from tabsieve.operators import evaluate as E

    li = tables_mid.lineitem.select((F.col("l_orderkey") % 150).cast("string").alias("a"),
                                    (F.col("l_partkey") % 150).cast("string").alias("p"))
    assert E.confusion_long(li, "a", "p").count() > 10_000
    big = {r["label"]: tuple(r)[1:] for r in E.classification_report(li, "a", "p", digits=9).collect()}
    assert len(big) == 153
    pdf = li.toPandas()
    assert big["accuracy"][0] == pytest.approx((pdf.a == pdf.p).mean(), abs=1e-9)
    assert big["7"][0] == pytest.approx(((pdf.a == "7") & (pdf.p == "7")).sum() / (pdf.p == "7").sum(), abs=1e-9)
    assert big["accuracy"][3] == li.count()


def test_split_ranks_do_not_depend_on_bucket_count(tables_small):
    from tabsieve.operators import split as S

    li = tables_small.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    a = S.stratified_rank(li, "l_returnflag", ["l_orderkey", "l_linenumber"], seed=3, digits=3)
    b = S.stratified_rank(li, "l_returnflag", ["l_orderkey", "l_linenumber"], seed=3, digits=5)
    key = ["l_orderkey", "l_linenumber", "l_returnflag", "rank", "n_label"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    assert S.prefix_digits(li) == S.HASH_PREFIX_DIGITS


def test_repeated_groups_by_distinct_member(tables_small):
    from pyspark.sql import functions as F
    from tabsieve.operators.aggregates import repeated_groups

    o = tables_small.orders.select("o_custkey", "o_orderkey")
    doubled = o.unionByName(o)                      # every order twice, as a fan-out join would
    plain = {r["o_custkey"]: r["size"] for r in repeated_groups(o, "o_custkey", top=None).collect()}
    by_member = {r["o_custkey"]: r["size"] for r in
                 repeated_groups(doubled, "o_custkey", top=None, member="o_orderkey").collect()}
    assert by_member == plain
    rows = {r["o_custkey"]: r["size"] for r in repeated_groups(doubled, "o_custkey", top=None).collect()}
    assert all(rows[k] == 2 * v for k, v in plain.items())


def test_group_folds_keep_groups_together(tables_mid):
    from pyspark.sql import functions as F
    from tabsieve.operators.split import group_folds, group_split

    li = tables_mid.lineitem.select("l_orderkey", "l_linenumber")
    f = group_folds(li, "l_orderkey", k=5, seed=3)
    assert f.groupBy("l_orderkey").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 0.15 * li.count()
    s = group_split(li, "l_orderkey", seed=3)
    assert s.groupBy("l_orderkey").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
