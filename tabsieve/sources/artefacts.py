"""Artefact registry over a folder of run outputs.

Listings come from the ``binaryFile`` source without reading contents, so
the registry is a small metadata table; selection is an aggregate
(``max_by``), never a driver-side sort of file names.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import stamp_of
from .io import binary_files

# The artefact kinds that make a complete run.
RUN_KINDS = ["model", "scaler", "label_encoder", "feature_names"]


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stamp, kind, modificationTime, length) per file."""
    files = binary_files(spark, folder, glob, with_content=False)
    name = F.element_at(F.split("path", "/"), -1)
    stamp = stamp_of(name)
    kind = F.regexp_replace(F.regexp_replace(name, r"_\d{8}_\d{6}.*$", ""), r"\.[^.]*$", "")
    return files.select("path", name.alias("name"), stamp.alias("stamp"), kind.alias("kind"),
                        "modificationTime", "length")


def latest(files: DataFrame, kind: str | None = None) -> DataFrame:
    """The most recently modified file (of a kind), as one row."""
    f = files if kind is None else files.filter(F.col("kind") == kind)
    return f.agg(F.max_by("path", "modificationTime").alias("path"),
                 F.max_by("stamp", "modificationTime").alias("stamp"),
                 F.max("modificationTime").alias("modificationTime"))


def related(files: DataFrame, anchor_stamp: str, kind: str, prefix_len: int = 9) -> DataFrame:
    """The latest file of ``kind`` whose stamp shares the first
    ``prefix_len`` characters with the anchor (date part); falls back to the
    latest file of that kind overall."""
    k = files.filter(F.col("kind") == kind)
    same = F.substring("stamp", 1, prefix_len) == F.lit(anchor_stamp[:prefix_len])
    g = k.agg(F.max_by(F.when(same, F.col("path")), F.when(same, F.col("modificationTime"))).alias("p_match"),
              F.max_by("path", "modificationTime").alias("p_any"))
    return g.select(F.coalesce("p_match", "p_any").alias("path"), F.col("p_match").isNotNull().alias("matched"))


def completeness(files: DataFrame, kinds: Sequence[str] = RUN_KINDS) -> DataFrame:
    """Per stamp, which kinds exist and whether the run is complete."""
    f = files.filter(F.col("stamp").isNotNull() & F.col("kind").isin(list(kinds)))
    g = f.groupBy("stamp").agg(F.array_sort(F.collect_set("kind")).alias("kinds"),
                               F.sum("length").alias("bytes"))
    return g.withColumn("complete", F.size("kinds") == len(kinds)).withColumn(
        "size_kb", F.col("bytes") / 1024.0)


def latest_complete_run(files: DataFrame, kinds: Sequence[str] = RUN_KINDS) -> DataFrame:
    """The newest complete run (by stamp)."""
    c = completeness(files, kinds).filter("complete")
    return c.orderBy(F.desc("stamp")).limit(1)
