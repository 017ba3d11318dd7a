"""A keyed table laid out for updates and lookups.

Rows lie in ``n_buckets`` buckets by a hash of the key, each bucket's files
sorted by it. A manifest names the folder that holds each bucket; a change
writes new folders for the buckets it touches and appends one manifest file,
whose arrival is the commit. Other buckets' files are not read and not written,
and readers see the version before or the one after. One writer at a time.

Keys must be unique (checked on writing and on updates). Null keys are a bucket
like others and never match an update. Updates without a target row are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import bounded_broadcast
from .publish import assert_unique

MANIFEST = "version long, bucket int, path string, n_buckets int, key string, schema string"


@dataclass
class Layout:
    """The current version: one folder per bucket that holds rows."""
    key: str
    n_buckets: int
    schema: str
    paths: dict[int, str]

    def bucket(self, key: Column) -> Column:
        return bucket_of(key, self.n_buckets)

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of ``buckets`` (all by default)."""
        at = [self.paths[b] for b in (sorted(self.paths) if buckets is None else buckets) if b in self.paths]
        return spark.read.schema(self.schema).parquet(*at) if at else spark.createDataFrame([], self.schema)


def bucket_of(key: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def layout(spark: SparkSession, base: str) -> Layout:
    """The manifest's newest entry of every bucket (at most ``n_buckets`` rows)."""
    m = spark.read.schema(MANIFEST).json(f"{base}/_manifest")
    got = m.groupBy("bucket").agg(F.max_by(F.struct("path", "n_buckets", "key", "schema"), "version").alias("e")).select("bucket", "e.*").collect()
    if not got:
        raise RuntimeError(f"{base}/_manifest names no bucket")
    return Layout(got[0]["key"], got[0]["n_buckets"], got[0]["schema"], {r["bucket"]: r["path"] for r in got if r["path"]})


def _commit(rows: DataFrame, base: str, key: str, n_buckets: int, buckets: Sequence[int], schema: str) -> None:
    """Write ``rows`` (they carry ``__bucket``) and name their folders. Buckets
    without rows are named without a folder."""
    spark, version = rows.sparkSession, time.time_ns()
    folder = f"{base}/v{version}"
    rows.sortWithinPartitions("__bucket", key).write.partitionBy("__bucket").parquet(folder)
    filled = {r[0] for r in spark.read.schema(f"{schema}, __bucket int").parquet(folder).select("__bucket").distinct().collect()}
    entries = [(version, b, f"{folder}/__bucket={b}" if b in filled else None, n_buckets, key, schema) for b in buckets]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{base}/_manifest")


def create(df: DataFrame, base: str, key: str, n_buckets: int = 256) -> None:
    """K2 into this layout: one shuffle by bucket. Choose ``n_buckets`` so that a
    bucket is a few hundred MB."""
    assert_unique(df, key)
    rows = df.withColumn("__bucket", bucket_of(F.col(key), n_buckets)).repartition(n_buckets, "__bucket")
    _commit(rows, base, key, n_buckets, range(n_buckets), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def merged(spark: SparkSession, at: Layout, updates: DataFrame, cols: Sequence[str], buckets: Sequence[int]) -> DataFrame:
    """The rows of ``buckets`` with ``cols`` taken from their updates. Updates of
    a checked size are broadcast, so the table itself is not shuffled; larger
    ones meet it in a sort-merge join."""
    u = updates.select(F.col(at.key).alias("__key"), *[F.col(c).alias(f"__new_{i}") for i, c in enumerate(cols)], F.lit(True).alias("__hit"))
    target = at.read(spark, buckets)
    j = target.join(bounded_broadcast(u), F.col(at.key) == F.col("__key"), "left")
    new = {c: F.col(f"__new_{i}") for i, c in enumerate(cols)}
    kept = [F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in new else F.col(c)
            for c in target.columns]
    return j.select(*kept).withColumn("__bucket", at.bucket(F.col(at.key)))


def upsert(spark: SparkSession, base: str, updates: DataFrame, cols: Sequence[str]) -> list[int]:
    """K3: set ``cols`` of the rows whose key is in ``updates`` (null included);
    returns the buckets written anew: those that an update's key falls in."""
    at = layout(spark, base)
    updates = updates.select(F.col(at.key).cast(spark.createDataFrame([], at.schema).schema[at.key].dataType).alias(at.key), *cols)
    updates = updates.filter(F.col(at.key).isNotNull())
    assert_unique(updates, at.key)
    hit = {r[0] for r in updates.select(at.bucket(F.col(at.key))).distinct().collect()}       # at most n_buckets
    touched = sorted(hit & set(at.paths))
    if touched:
        _commit(merged(spark, at, updates, cols, touched), base, at.key, at.n_buckets, touched, at.schema)
    return touched


def lookup(spark: SparkSession, base: str, value: Any) -> DataFrame:
    """the row with a key: one bucket's files, whose sorted key lets the
    scan skip row groups. No row where the key is absent."""
    at = layout(spark, base)
    kind = spark.createDataFrame([], at.schema).schema[at.key].dataType
    v = F.lit(value).cast(kind)
    b = spark.range(1).select(at.bucket(v)).first()[0]
    return at.read(spark, [b]).filter(F.col(at.key) == v)
