"""Filters and predicates (F1-F11). Written as Column predicates so Catalyst
can push the comparable ones into the Parquet scan (PushedFilters)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import _c, normalise_param


def eq_param(col: str, value: str | None) -> Column | None:
    """equality with a normalised parameter (upper, '_' -> space); None
    parameter means no predicate."""
    v = normalise_param(value)
    return None if v is None else (F.col(col) == F.lit(v))


def true_only(col: str, enabled: bool) -> Column | None:
    """keep rows where a nullable boolean is true (null excluded)."""
    return F.col(col) if enabled else None


def conjunction(preds: Sequence[Column | None]) -> Column | None:
    """AND of the given predicates, skipping None."""
    ps = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, ps) if ps else None


def where(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.filter(pred)


def in_range(col: str, lo, hi) -> Column:
    """closed range."""
    return F.col(col).between(lo, hi)


class NotFoundError(LookupError):
    """no row has the key."""


def lookup(df: DataFrame, key: str, value, order: Sequence[str] = ()) -> DataFrame:
    """All rows for one key, ordered; an empty result raises
    NotFoundError (checked with ``limit(1)``, not a full count)."""
    out = df.filter(F.col(key) == F.lit(value))
    if order:
        out = out.orderBy(*order)
    if out.limit(1).isEmpty():
        raise NotFoundError(f"{key}={value!r} not found")
    return out


def any_not_null(df: DataFrame, col: str) -> bool:
    """does the column hold any non-null value (stops at the first)."""
    return col in df.columns and not df.filter(F.col(col).isNotNull()).limit(1).isEmpty()


def min_content(df: DataFrame, text_col: str, min_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """split into (kept, quarantined) by stripped length >= min_chars."""
    from ..functions.text import py_strip

    ok = F.length(py_strip(F.col(text_col))) >= min_chars
    return df.filter(ok), df.filter(~ok | F.col(text_col).isNull())
