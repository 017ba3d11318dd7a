"""The corpus pipeline: STAGES in order, each written and read again as the
next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from tabsieve.llm.common import benchmark, documents, ready, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without a letter or far from
    every language go. Learned from the documents that are not held out."""
    ready(spark)
    return language_id.keep_identified(docs, language_id.fit(language_id.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ready(spark)
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    ready(spark)
    return decontaminate.drop_leaks(docs, benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    ready(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, whole, with its shard of 16 that all match the mixture."""
    ready(spark)
    return sharding.place(sharding.measured(docs)).drop("position")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("source_mix", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None   # k-means centroids and BM25 passages have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to
    the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
