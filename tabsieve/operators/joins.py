"""Joins (J1-J7). Broadcast only behind a measured size bound; otherwise let
the planner pick sort-merge, with AQE free to switch at runtime and to split
skewed partitions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import suffix_overlaps

# Largest side we broadcast explicitly (rows and bytes); above it the planner decides.
BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 128 << 20


_FIXED_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
                T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
                T.DecimalType: 16}


def _value_bytes(f: T.StructField) -> Column:
    """Bytes of one value: fixed width for primitives, UTF-8/binary length
    for strings and binaries, the JSON text length for nested values."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(c))
    else:
        size = F.lit(_FIXED_WIDTH.get(type(f.dataType), 8))
    return F.coalesce(size, F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT,
                      max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast hint only when the side has at most ``max_rows`` rows and
    ``max_bytes`` bytes of values.

    The check aggregates ``limit(max_rows + 1)``: a bounded scan that stops
    early, so it costs at most max_rows rows of work even on a huge table.
    Above either bound the frame is returned unhinted (sort-merge / AQE).
    """
    sizes = [_value_bytes(f) for f in df.schema.fields] or [F.lit(0).cast("long")]
    row = sizes[0]
    for s_ in sizes[1:]:
        row = row + s_
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("b")).first()
    return F.broadcast(df) if r["n"] <= max_rows and (r["b"] or 0) <= max_bytes else df


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              null_safe: bool = False, suffix: str = "_right", broadcast_right: bool | None = None) -> DataFrame:
    """Left equi-join on differently named keys, one-to-many fan-out
    kept, colliding right columns suffixed. ``null_safe`` matches null keys
    to null keys (pandas semantics); the default does not.

    ``broadcast_right``: True = checked broadcast, False = no hint, None =
    planner/AQE decide.
    """
    right = suffix_overlaps(left, right, keys=(), suffix=suffix)
    rk = right_key if right_key in right.columns else f"{right_key}{suffix}"
    if broadcast_right:
        right = bounded_broadcast(right)
    cond = left[left_key].eqNullSafe(right[rk]) if null_safe else (left[left_key] == right[rk])
    return left.join(right, cond, "left")
