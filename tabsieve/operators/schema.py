"""Projection and schema operators (P1-P15). These only build select lists;
Catalyst pushes the resulting column set into the scan (ReadSchema)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import _c


class MissingColumnsError(ValueError):
    """Raised when required columns are absent."""

    def __init__(self, missing: Sequence[str]):
        super().__init__(f"missing required columns: {', '.join(missing)}")
        self.missing = list(missing)


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise MissingColumnsError unless every required column exists."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing)
    return df


def curated_select(df: DataFrame, allow_groups: Sequence[Sequence[str]], deny: Iterable[str] = ()) -> DataFrame:
    """Allow-list groups in order, minus the deny list (deny wins), keeping
    only columns that exist, each once."""
    deny = set(deny)
    seen: list[str] = []
    for group in allow_groups:
        for c in group:
            if c in df.columns and c not in deny and c not in seen:
                seen.append(c)
    return df.select(*seen)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename existing columns (absent ones are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def fold_to_map(df: DataFrame, prefix: str, out: str, drop: bool = True) -> DataFrame:
    """Fold ``<prefix><class>`` columns into map<class, value>."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return df.withColumn(out, F.lit(None).cast("map<string,double>"))
    m = F.map_from_arrays(F.array(*[F.lit(c[len(prefix):]) for c in cols]),
                          F.array(*[F.col(c).cast("double") for c in cols]))
    df = df.withColumn(out, m)
    return df.drop(*cols) if drop else df


def drop_by_patterns(df: DataFrame, patterns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose lower-cased name contains any pattern."""
    pats = [p.lower() for p in patterns]
    keep = set(keep)
    return df.drop(*[c for c in df.columns if c not in keep and any(p in c.lower() for p in pats)])


def numeric_only(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Keep numeric columns (plus ``keep``)."""
    keep = set(keep)
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) or f.name in keep])


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text columns to double, bad values -> null (``try_cast``)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def align_to_features(df: DataFrame, features: Sequence[str], fill: float | None = 0.0,
                      keep: Sequence[str] = ()) -> DataFrame:
    """Select ``features`` in order; absent ones become ``fill`` (0.0 by
    default, null when ``fill`` is None). ``keep`` columns are carried first."""
    sel: list[Column] = [F.col(k) for k in keep]
    for f in features:
        sel.append(F.col(f).cast("double").alias(f) if f in df.columns
                   else F.lit(fill).cast("double").alias(f))
    return df.select(*sel)


def missing_features(df: DataFrame, features: Sequence[str], head: int = 10) -> DataFrame:
    """P10: per row, the features that are null (or absent): count and the
    first ``head`` names, as native array expressions."""
    present = [f for f in features if f in df.columns]
    absent = [f for f in features if f not in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).isNull().alias("miss")) for f in present],
                    *[F.struct(F.lit(f).alias("name"), F.lit(True).alias("miss")) for f in absent])
    miss = F.transform(F.filter(pairs, lambda s: s["miss"]), lambda s: s["name"])
    return df.withColumn("missing_count", F.size(miss)).withColumn("missing_head", F.slice(miss, 1, head))


def to_records(df: DataFrame, out: str = "record") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(out))


def feature_names(n: int, names: Sequence[str] | None = None, vector_meta: dict | None = None) -> list[str]:
    """Names from a list, else from vector attribute metadata, else
    generic ``feature_i``."""
    if names and len(names) == n:
        return list(names)
    if vector_meta:
        attrs = vector_meta.get("ml_attr", {}).get("attrs", {})
        flat = sorted((a["idx"], a["name"]) for grp in attrs.values() for a in grp if "name" in a)
        if len(flat) == n:
            return [nm for _, nm in flat]
    return [f"feature_{i}" for i in range(n)]


def suffix_overlaps(left: DataFrame, right: DataFrame, keys: Iterable[str] = (), suffix: str = "_right") -> DataFrame:
    """Rename right-side non-key columns that collide with the left."""
    keys = set(keys)
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return right.withColumnsRenamed(clash) if clash else right
