"""Publishing scored tables.

Plain Parquet has no row-level MERGE, so a keyed update is a left join of
the target with the update set (co-partitioned on the key by the planner)
that writes a NEW snapshot folder; a one-row pointer file, appended for each
version, then names it, and the newest pointer is the current one. No file is
ever replaced: readers see the version before or the one after, and a lost
executor only re-runs tasks of the snapshot being written.
"""

from __future__ import annotations

import time
import uuid
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import any_not_null


class DuplicateKeyError(ValueError):
    """K6: the key is not unique."""


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """K6 check: keys that occur more than once, with their counts. A plain
    aggregate (map-side partial counts), safe with a hot key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def assert_unique(df: DataFrame, key: str | Sequence[str]) -> None:
    if not duplicate_keys(df, key).limit(1).isEmpty():
        raise DuplicateKeyError(f"key {key!r} is not unique")


def upsert(target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], flag: str | None = "updated",
           check_unique: bool = True) -> DataFrame:
    """K3: set ``cols`` from ``updates`` on target rows with the same key;
    other target rows keep their values; update rows without a target row
    are ignored (update, not insert). A matched update with a null value
    sets null (no coalesce). Duplicate update keys are rejected (quirk 7)."""
    if check_unique:
        assert_unique(updates, key)
    u = updates.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in cols]).withColumn("__hit", F.lit(True))
    j = target.join(u, key, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = j.withColumns({c: F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)) for c in cols})
    if flag:
        out = out.withColumn(flag, hit)
    return out.drop("__hit", *[f"__new_{c}" for c in cols])


def match_counts(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """How many update rows match a target key and how many do not.
    Update rows are first counted per key (map-side partial counts, so a key
    holding a third of the updates is one row per task), then the per-key
    counts are left-joined to the distinct target keys; both sides are
    hash-partitioned on the key by their aggregates, so the join adds no
    shuffle."""
    keys = target.select(key).distinct().withColumn("__m", F.lit(1))
    per = updates.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = per.join(keys, key, "left")
    zero = F.lit(0).cast("long")
    return j.agg(F.coalesce(F.sum("__n"), zero).alias("n_updates"),
                 F.coalesce(F.sum(F.when(F.col("__m").isNotNull(), F.col("__n"))), zero).alias("matched"),
                 F.coalesce(F.sum(F.when(F.col("__m").isNull(), F.col("__n"))), zero).alias("unmatched"))


# ---------------------------------------------------------------- snapshots
POINTER = "path string, version long"


def _pointer(base: str) -> str:
    return f"{base.rstrip('/')}/_current"


def current_snapshot(spark: SparkSession, base: str) -> str | None:
    """The newest published snapshot's folder; None before the first publish
    (no pointer folder). A pointer folder that cannot be read, or holds no
    pointer, is an error: it never counts as a first publish."""
    try:
        pointers = spark.read.schema(POINTER).json(_pointer(base))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    r = pointers.filter(F.col("path").isNotNull()).orderBy(F.desc("version")).first()
    if r is None:
        raise RuntimeError(f"{_pointer(base)} names no snapshot")
    return r["path"]


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    p = current_snapshot(spark, base)
    return spark.read.parquet(p) if p else None


def write_snapshot(df: DataFrame, base: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` to a fresh snapshot folder, then append its pointer."""
    spark = df.sparkSession
    path = f"{base.rstrip('/')}/snapshot-{time.strftime('%Y%m%d_%H%M%S')}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    spark.createDataFrame([(path, time.time_ns())], POINTER).coalesce(1).write.mode("append").json(_pointer(base))
    return path


def publish(df: DataFrame, base: str, key: str, cols: Sequence[str], guard_col: str | None = None) -> dict:
    """Q9: first publish writes everything (K2); later publishes upsert the
    prediction columns by key (K3); with ``guard_col`` the publish is
    skipped when the current snapshot already holds values there (K5)."""
    spark = df.sparkSession
    cur = read_current(spark, base)
    if cur is None:
        return {"action": "insert", "path": write_snapshot(df, base)}
    if guard_col and any_not_null(cur, guard_col):
        return {"action": "skipped", "path": current_snapshot(spark, base)}
    merged = upsert(cur, df.select(key, *cols), key, cols, flag=None)
    return {"action": "update", "path": write_snapshot(merged, base)}
