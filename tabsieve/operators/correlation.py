"""Pearson correlation of many columns.

Every task turns its Arrow batches into a NumPy block and emits, per column
pair, the masked partial sums n, sum x, sum y, sum x^2, sum y^2, sum xy over
the rows where both values are present (pairwise-complete, like pandas). The
partials are p*(p-1)/2 rows per task, independent of the row count, and are
summed by a ``groupBy(i, j)`` (map-side combined). Columns are centred by
their mean first to avoid cancellation. NaN counts as null.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from .partitioning import spread

_PARTIAL_SCHEMA = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _gram_partials(cols: Sequence[str], means: Sequence[float]):
    p = len(cols)
    mu = np.asarray(means, dtype="float64")
    iu, ju = np.triu_indices(p, k=1)

    def run(batches):
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf[list(cols)].to_numpy(dtype="float64", na_value=np.nan)
            m = (~np.isnan(x)).astype("float64")
            z = np.where(m > 0, x - mu, 0.0)
            z2 = z * z
            part = (m.T @ m, z.T @ m, z2.T @ m, z.T @ z)
            acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
        if acc is None:
            return
        n, zm, z2m, zz = acc
        yield pd.DataFrame({
            "i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju],
            "sx": zm[iu, ju], "sy": zm[ju, iu], "sxx": z2m[iu, ju], "syy": z2m[ju, iu], "sxy": zz[iu, ju],
        })
    return run


def correlation_pairs(df: DataFrame, cols: Sequence[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Upper-triangle pairs (i, j, col_i, col_j, n, r) with i < j.

    ``fill``: per-column constants substituted for nulls first (the median
    filled variant); without it correlation is pairwise-complete. ``r`` is
    null when either side has zero variance on the shared rows.
    """
    cols = list(cols)
    value = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    x = df.select(*[(F.coalesce(value[c], F.lit(float(fill[c]))) if fill and c in fill else value[c]).alias(c) for c in cols])
    names = F.array(*[F.lit(c) for c in cols])
    means = x.agg(*[F.mean(c).alias(c) for c in cols]).first()
    mu = [float(means[c]) if means[c] is not None else 0.0 for c in cols]
    parts = spread(x).mapInPandas(_gram_partials(cols, mu), _PARTIAL_SCHEMA)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((n > 1) & (vx > 0) & (vy > 0),
               F.least(F.greatest(cov / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0)))
    out = s.select("i", "j", "n", r.alias("r"))
    return out.select("i", "j", F.element_at(names, F.col("i") + 1).alias("col_i"),
                      F.element_at(names, F.col("j") + 1).alias("col_j"), "n", "r")
