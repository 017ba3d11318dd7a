"""Bounded-memory exact medians against numpy on awkward distributions."""

import numpy as np
import pandas as pd

from tabsieve.operators import quantiles as Q


import pytest


@pytest.mark.parametrize("keep,accuracy", [(Q.KEEP, Q.ACCURACY), (20, 50)])   # the second refines in rounds
def test_medians_match_numpy(spark, keep, accuracy):
    rng = np.random.default_rng(3)
    n = 20001
    cols = {
        "normal": rng.normal(size=n),
        "heavy": np.exp(rng.normal(scale=6, size=n)),          # huge range, median bin crowded
        "ties": rng.integers(0, 3, size=n).astype(float),        # one-value bins
        "even": np.concatenate([rng.normal(size=n - 1), [np.nan]]),  # even count after null
        "spike": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n)),
        "allnull": np.full(n, np.nan),
        "signed": np.where(rng.random(n) < 0.1, 0.0, rng.normal(scale=1e-3, size=n)),   # zeros, negatives
        "edges": 2.0 ** rng.integers(-1074, 1023, size=n).astype(float) * rng.choice([-1, 1], size=n),
        "tiny": rng.integers(1, 50, size=n) * 5e-324,                                   # subnormals
        "infs": np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.5, -np.inf, rng.normal(size=n))),
    }
    pdf = pd.DataFrame(cols)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in cols))
    got = {d["column"]: d for d in Q.column_stats(df, list(cols), ("mean", "min", "max"), keep=keep, accuracy=accuracy)}
    for c, v in cols.items():
        vals = v[~np.isnan(v)]
        if len(vals) == 0:
            assert got[c]["median"] is None and got[c]["count"] == 0
        else:
            assert got[c]["median"] == np.median(vals), c
            assert got[c]["count"] == len(vals)


def test_a_sketch_that_is_off_is_corrected(spark):
    df = spark.range(1, 10_001).selectExpr("cast(id as double) AS c0")
    for lo, hi in ((1.0, 3.0), (9000.0, 9500.0), (5000.0, 5000.0), (4990.0, 5001.0)):
        t = {"col": 0, "n": 10_000, "lo": lo, "hi": hi, "below": 0, "inside": 10_000, "open": (None, None), "ranks": [4999, 5000]}
        assert Q.ranked_values(df, [t], 50_000, 10_000) == {(0, 4999): 5000.0, (0, 5000): 5001.0}


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    (d,) = Q.column_stats(df, ["x"])
    assert (d["count"], d["total"], d["median"], d["mean"]) == (2, 4, 2.0, 2.0)
