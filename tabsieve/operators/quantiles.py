"""Exact medians with bounded memory, plus the one-pass column statistics
that go with them.

Spark's exact ``median`` keeps a map of every distinct value per group; on a
global aggregate all maps merge into one task, which does not survive a
column with 10^11 distinct values. Here every pass is one flat aggregate over
the wide rows (no row is exploded), whatever the size of the input:

1. one scan gives the requested moments and, from a quantile sketch of
   bounded size, a bracket [lo, hi] of actual values around the middle ranks;
2. another scan counts the rows below lo, at lo, between, at hi. A middle
   rank at lo or hi is answered; one between them is, while the rows between
   may be more than ``KEEP``, bracketed again among them (a sketch narrows a
   bracket some thousandfold);
3. the at most ``KEEP`` values between the brackets are sorted and read at
   their ranks.

Only per-column scalars reach the driver. NaN counts as null.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from .partitioning import reusable

STAT_FUNCS = {
    "mean": F.mean, "min": F.min, "max": F.max, "var_samp": F.var_samp, "stddev_pop": F.stddev_pop,
    "stddev_samp": F.stddev_samp,
}

ACCURACY = 10_000     # of the sketch: its ranks are off by at most rows / ACCURACY
KEEP = 50_000         # values of a column sorted at the end


def column_stats(df: DataFrame, cols: Sequence[str], stats: Sequence[str] = ("mean", "min", "max"),
                 median: bool = True, keep: int = KEEP, accuracy: int = ACCURACY) -> list[dict]:
    """Per column dict: name, count, total, requested stats and (exact)
    median. Only per-column scalars reach the driver."""
    cols = list(cols)
    with reusable(df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])) as x:
        aggs = [F.count(F.lit(1)).alias("total")]
        for i in range(len(cols)):
            v = F.col(f"c{i}")
            aggs += [F.count(v).alias(f"n{i}"), *[STAT_FUNCS[s](v).alias(f"{s}{i}") for s in stats]]
            if median:
                aggs.append(bracket(v, F.lit(0.5), F.lit(0.5), accuracy).alias(f"q{i}"))
        r = x.agg(*aggs).first()
        out = [{"pos": i, "column": c, "count": r[f"n{i}"], "total": r["total"], "median": None,
                **{s: r[f"{s}{i}"] for s in stats}} for i, c in enumerate(cols)]
        if median:
            targets = [{"col": i, "n": d["count"], "lo": r[f"q{i}"][0], "hi": r[f"q{i}"][1], "below": 0, "inside": d["count"],
                        "open": (None, None), "ranks": sorted({(d["count"] - 1) // 2, d["count"] // 2})}
                       for i, d in enumerate(out) if d["count"]]
            values = ranked_values(x, targets, keep, accuracy)
            for i, d in enumerate(out):
                if d["count"]:
                    a, b = values[i, (d["count"] - 1) // 2], values[i, d["count"] // 2]
                    d["median"] = a if a == b else (a + b) / 2.0
    return out


def bracket(v: Column, low: Column, high: Column, accuracy: int) -> Column:
    """[lo, hi]: values of ``v`` whose ranks, as shares, surround low to high:
    the sketch's values two of its errors outside them."""
    off = F.lit(2.0 / accuracy)
    return F.percentile_approx(v, F.array(F.greatest(low - off, F.lit(0.0)), F.least(high + off, F.lit(1.0))), accuracy)


def inside(v: Column, interval: tuple) -> Column:
    """Whether a value lies in an open interval; None is no bound."""
    a, b = interval
    return (F.lit(True) if a is None else v > a) & (F.lit(True) if b is None else v < b) & v.isNotNull()


def ranked_values(x: DataFrame, targets: list[dict], keep: int, accuracy: int) -> dict:
    """{(column, rank): value} for 0-based ranks. Of each target, ``below``
    rows lie under the open interval ``open``, ``inside`` rows in it, and
    [``lo``, ``hi``] is the bracket to look at next."""
    done: dict = {}
    todo = targets
    while todo:
        aggs = []
        for k, t in enumerate(todo):
            v = F.col(f"c{t['col']}")
            within = inside(v, t["open"])
            inner = F.when((v > t["lo"]) & (v < t["hi"]), v)
            aggs += [F.count_if(within & (v < t["lo"])).alias(f"below{k}"), F.count_if(within & (v == t["lo"])).alias(f"lo{k}"),
                     F.count(inner).alias(f"in{k}"), F.count_if(within & (v == t["hi"])).alias(f"hi{k}")]
            # the rows between the bracket's ends are at most six sketch errors
            t["fits"] = 6 * t["inside"] / accuracy + 2 <= keep
            if t["fits"]:
                aggs.append(F.array_sort(F.collect_list(inner)).alias(f"v{k}"))
        r = x.agg(*aggs).first()
        after = []
        for k, t in enumerate(todo):
            lo, hi = t["lo"], t["hi"]
            start = t["below"] + r[f"below{k}"]
            at_lo, inner, at_hi = r[f"lo{k}"], r[f"in{k}"], r[f"hi{k}"] if hi != lo else 0
            for rank in t["ranks"]:
                p = rank - start
                if 0 <= p < at_lo:
                    done[t["col"], rank] = lo
                elif 0 <= p - at_lo - inner < at_hi:
                    done[t["col"], rank] = hi
                elif at_lo <= p < at_lo + inner and t["fits"]:
                    done[t["col"], rank] = r[f"v{k}"][p - at_lo]
                elif at_lo <= p < at_lo + inner:
                    share = (p - at_lo) / inner
                    after.append({**t, "open": (lo, hi), "below": start + at_lo, "inside": inner, "ranks": [rank], "share": share})
                elif p < 0:           # the sketch was off: look below the bracket
                    after.append({**t, "open": (t["open"][0], lo), "inside": r[f"below{k}"], "ranks": [rank],
                                  "share": (rank - t["below"]) / max(1, r[f"below{k}"])})
                else:                 # or above it
                    gone = at_lo + inner + at_hi
                    after.append({**t, "open": (hi, t["open"][1]), "below": start + gone, "ranks": [rank],
                                  "inside": t["inside"] - r[f"below{k}"] - gone,
                                  "share": (p - gone) / max(1, t["inside"] - r[f"below{k}"] - gone)})
        if after:
            aggs = []
            for k, t in enumerate(after):
                v = F.col(f"c{t['col']}")
                aggs.append(bracket(F.when(inside(v, t["open"]), v), F.lit(t["share"]), F.lit(t["share"]), accuracy).alias(f"q{k}"))
            r = x.agg(*aggs).first()
            for k, t in enumerate(after):
                t["lo"], t["hi"] = r[f"q{k}"]
        todo = after
    return done
