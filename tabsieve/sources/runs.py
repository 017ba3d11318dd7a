"""Run registry: records of training runs as VARIANT rows.

A record is (run, stamp, kind, payload, written). Payloads are of any shape: a
report may hold maps per class beside plain numbers, importances may be an
object or a list, and runs of different versions differ. They are kept as
VARIANT and read by path, so no schema has to cover them all. Appending never
rewrites a file; a kind written twice in a run counts with its latest record.

Missing parts give null or no rows, never an error: a payload of another shape,
a null payload, a run without a stamp (never the latest), an empty registry.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("metrics", "feature_names", "importances")   # what makes a run complete
SCHEMA = "run string, stamp string, kind string, payload variant, written timestamp"


def create(spark: SparkSession, base: str) -> None:
    """An empty registry."""
    spark.createDataFrame([], SCHEMA.replace("variant", "string")).withColumn(
        "payload", F.parse_json("payload")).write.parquet(base)


def report_payload(report: DataFrame) -> DataFrame:
    """A24's rows as one payload: an object per class and average, accuracy a number."""
    scores = F.to_variant_object(F.struct("precision", "recall", "f1", "support"))
    value = F.when(F.col("label") == "accuracy", F.col("f1").cast("variant")).otherwise(scores)
    entries = F.map_from_entries(F.collect_list(F.struct("label", value.alias("v"))))     # classes + 3 entries
    return report.agg(F.to_variant_object(entries).alias("payload"))


def literal_payload(spark: SparkSession, json: str | None) -> DataFrame:
    """A payload given as JSON text."""
    return spark.createDataFrame([(json,)], "j string").select(F.try_parse_json("j").alias("payload"))


def append(payload: DataFrame, base: str, run: str, stamp: str | None, kind: str) -> None:
    """Add the one row of ``payload`` as a record."""
    payload.select(F.lit(run).alias("run"), F.lit(stamp).cast("string").alias("stamp"), F.lit(kind).alias("kind"), "payload",
                   F.current_timestamp().alias("written")).write.mode("append").parquet(base)


def load(spark: SparkSession, base: str) -> DataFrame:
    """The current record of every (run, kind)."""
    w = Window.partitionBy("run", "kind").orderBy(F.desc("written"))
    return spark.read.parquet(base).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def runs(records: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Per run its stamp, its kinds and whether all of ``kinds`` are there."""
    g = records.groupBy("run").agg(F.max("stamp").alias("stamp"),
                                   F.array_sort(F.collect_set(F.when(F.col("payload").isNotNull(), F.col("kind")))).alias("kinds"))
    return g.withColumn("complete", F.size(F.array_intersect("kinds", F.array(*map(F.lit, kinds)))) == len(set(kinds)))


def latest_complete(records: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Q6: the records of the newest complete run, equal stamps by the greater
    name. One row per run is compared."""
    best = runs(records, kinds).filter("complete and stamp is not null").agg(F.max(F.struct("stamp", "run")).alias("b"))
    return records.join(best.select(F.col("b")["run"].alias("run")), "run")


def metrics(records: DataFrame) -> DataFrame:
    """(run, name, metric, value) of the metrics records: an entry that is a
    number has the metric ``value``, one that is an object a row per number in it."""
    entries = records.filter("kind = 'metrics'").select("run", F.explode(F.expr("try_cast(payload as map<string, variant>)")).alias("name", "v"))
    inner = F.coalesce(F.expr("try_cast(v as map<string, variant>)"), F.create_map(F.lit("value"), F.col("v")))
    rows = entries.select("run", "name", F.explode(inner).alias("metric", "v"))
    return rows.select("run", "name", "metric", F.expr("try_cast(v as double)").alias("value")).filter("value is not null")


def importances(records: DataFrame, top: int = 10) -> DataFrame:
    """(run, rank, feature, importance), the ``top`` of every run; payloads may be
    an object feature -> number or a list of {feature, importance}."""
    rec = records.filter("kind = 'importances'")
    as_object = rec.select("run", F.explode(F.expr("try_cast(payload as map<string, variant>)")).alias("feature", "v")).select(
        "run", "feature", F.expr("try_cast(v as double)").alias("importance"))
    as_list = rec.select("run", F.explode(F.expr("try_cast(payload as array<variant>)")).alias("v")).select(
        "run", F.try_variant_get("v", "$.feature", "string").alias("feature"), F.try_variant_get("v", "$.importance", "double").alias("importance"))
    rows = as_object.unionByName(as_list).filter("feature is not null and importance is not null")
    w = Window.partitionBy("run").orderBy(F.desc("importance"), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("run", "rank", "feature", "importance")


def status(records: DataFrame) -> DataFrame:
    """Per run its stamp, completeness, number of features and classes, accuracy."""
    features = F.max(F.when(F.col("kind") == "feature_names", F.size(F.expr("try_cast(payload as array<variant>)"))))
    m = metrics(records).groupBy("run").agg(
        F.count_if((F.col("metric") == "support") & ~F.col("name").isin("macro avg", "weighted avg")).alias("n_classes"),
        F.max(F.when((F.col("name") == "accuracy") & (F.col("metric") == "value"), F.col("value"))).alias("accuracy"))
    counted = records.groupBy("run").agg(features.alias("n_features"))
    return runs(records).join(counted, "run").join(m, "run", "left").select(
        "run", "stamp", "complete", "n_features", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), "accuracy")
