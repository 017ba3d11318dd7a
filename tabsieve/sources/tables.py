"""Driver-table loader. Parquet scans are lazy: Catalyst prunes columns and
pushes filters into each scan, so loading every table costs nothing until a
plan touches it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import nan_to_null_all

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; NaN in its number columns is read as null."""
    return nan_to_null_all(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


class Tables:
    """Attribute access to the driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def register_views(self) -> None:
        for t in TABLES:
            table(self.spark, self.sf_dir, t).createOrReplaceTempView(t)
