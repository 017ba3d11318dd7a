"""Column profiling and feature selection.

All per-column statistics come from ONE aggregate over the table; only the
resulting per-column metadata (bounded by the number of columns, never by
rows) is brought to the driver to decide which columns survive.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .correlation import correlation_pairs
from .quantiles import column_stats

# Default thresholds of the reference's selection rules.
MISSING_THRESHOLD = 0.5
CORR_THRESHOLD = 0.95

SELECTION_SCHEMA = ("pos int, column string, null_fraction double, variance double, "
                    "corr_partner string, partner_abs_r double, kept boolean, reason string")


def column_profile(df: DataFrame, cols: Sequence[str]) -> list[dict]:
    """Per column null fraction, sample variance, exact median, mean,
    population std and non-null count (dicts, one per column)."""
    out = []
    for d in column_stats(df, cols, ("var_samp", "mean", "stddev_pop")):
        n = d["total"]
        out.append({"pos": d["pos"], "column": d["column"], "count": d["count"],
                    "null_fraction": (1.0 - d["count"] / n) if n else None, "variance": d["var_samp"],
                    "median": d["median"], "mean": d["mean"], "std_pop": d["stddev_pop"]})
    return out


def select_features(df: DataFrame, cols: Sequence[str], missing: float = MISSING_THRESHOLD,
                    corr_threshold: float = CORR_THRESHOLD, fill: str = "median") -> DataFrame:
    """M1 -> M2 -> M3 in the reference's order: drop columns with null
    fraction > ``missing``; then zero sample variance (null variance is
    kept); then, over the survivors, the correlation rule on the
    upper triangle. ``fill='median'`` correlates median-filled values (trainer
    variant); ``fill='pairwise'`` uses pairwise-complete rows (search variant).

    Returns one row per input column with the decision and its reason.
    """
    cols = list(cols)
    df = df.select(*cols)
    spark: SparkSession = df.sparkSession
    prof = column_profile(df, cols)
    decision = {}
    for p in prof:
        if p["null_fraction"] is not None and p["null_fraction"] > missing:
            decision[p["column"]] = "missing"
        elif p["variance"] is not None and p["variance"] == 0:
            decision[p["column"]] = "zero_variance"
    survivors = [p["column"] for p in prof if p["column"] not in decision]
    medians = {p["column"]: p["median"] for p in prof if p["median"] is not None}
    partner: dict[str, tuple[str, float]] = {}
    if len(survivors) > 1:
        pairs = correlation_pairs(df, survivors, fill=medians if fill == "median" else None)
        for row in pairs.filter(F.abs("r") > corr_threshold).orderBy("j", "i").collect():
            if row["col_j"] not in partner:
                partner[row["col_j"]] = (row["col_i"], abs(row["r"]))
    for c, _ in partner.items():
        decision[c] = "correlated"
    rows = []
    for p in prof:
        c = p["column"]
        pr = partner.get(c)
        rows.append((p["pos"], c, p["null_fraction"], p["variance"], pr[0] if pr else None,
                     float(pr[1]) if pr else None, c not in decision, decision.get(c)))
    return spark.createDataFrame(rows, SELECTION_SCHEMA)
