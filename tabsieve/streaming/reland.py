"""Corpus ingest where a file landed again replaces its chunks.

Files arrive in a folder per delivery; their name says what they hold. Each
micro-batch writes its chunks to a folder of its own number and then its ledger
entry, one row per file, to another. The ledger is the commit: a reader takes,
of every file, the chunks of the last batch in the ledger that brought it. A
batch killed between the two writes is invisible, and repeated under the same
number it overwrites what it left. Nothing that is visible is ever rewritten.

Of a file delivered twice within one batch the later delivery counts (by
modification time, then path). A file without any row brings nothing and
replaces nothing. Null texts give no chunks, but their file is in the ledger.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text
from ..operators.chunk import CHUNK_SCHEMA, chunk_documents

LEDGER = "file string, path string, landed timestamp, ingested_at timestamp, batch long"


def landed(spark: SparkSession, folder: str, schema: str, name: Column | None = None, max_files: int = 100) -> DataFrame:
    """Stream of the rows of Parquet files under ``folder``, each with its ``file``
    (``name``, an expression over ``__path``; by default the file's name), path
    and modification time. A batch takes at most ``max_files`` files."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(folder)
    src = src.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_modification_time").alias("__landed"))
    return src.withColumn("__file", name if name is not None else F.element_at(F.split("__path", "/"), -1))


def _write_chunks(rows: DataFrame, base: str, batch: int, ids: Sequence[str], text: str, size: int, overlap: int) -> None:
    rows = rows.select("__file", *ids, clean_text(text).alias("__text"))
    chunks = chunk_documents(rows, ["__file", *ids], "__text", size, overlap).withColumnRenamed("__file", "file")
    chunks.write.mode("overwrite").parquet(f"{base}/chunks/batch={batch}")


def _write_ledger(files: DataFrame, base: str, batch: int) -> None:
    files.select(F.col("__file").alias("file"), F.col("__path").alias("path"), F.col("__landed").alias("landed"),
                 F.current_timestamp().alias("ingested_at")).coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/batch={batch}")


def start(stream: DataFrame, base: str, checkpoint: str, ids: Sequence[str], text: str = "text", size: int = 1000,
          overlap: int = 200) -> StreamingQuery:
    """Take what has landed since the last run, batch by batch."""

    def take(rows: DataFrame, batch: int) -> None:
        files = rows.groupBy("__file").agg(F.max(F.struct("__landed", "__path")).alias("m")).select("__file", "m.*")
        files = files.checkpoint()                       # at most max_files rows, read twice
        last = files.select("__path")
        _write_chunks(rows.join(F.broadcast(last), "__path", "left_semi"), base, batch, ids, text, size, overlap)
        _write_ledger(files, base, batch)

    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """Every file with the last batch that brought it; no rows before the first batch."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{base}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows.groupBy("file").agg(F.max("batch").alias("batch"), F.max_by("ingested_at", "batch").alias("ingested_at"))


def current(spark: SparkSession, base: str, ids: str) -> DataFrame:
    """The corpus as of now: of every file the chunks of its last batch. ``ids``
    is the schema of the id columns. One row per file meets the chunks; the
    batch is a folder, so folders without a current file are not read."""
    try:
        chunks = spark.read.schema(f"file string, {ids}, {CHUNK_SCHEMA}, batch long").parquet(f"{base}/chunks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        chunks = spark.createDataFrame([], f"file string, {ids}, {CHUNK_SCHEMA}, batch long")
    return chunks.join(ledger(spark, base).select("file", "batch"), ["file", "batch"])


def status(spark: SparkSession, base: str, ids: str, document: str) -> DataFrame:
    """Files, documents, chunks and the newest ingest of the current corpus."""
    files = ledger(spark, base).agg(F.count(F.lit(1)).alias("n_files"), F.max("ingested_at").alias("last_ingest"))
    chunks = current(spark, base, ids).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct(document).alias("n_documents"))
    return files.withColumn("__j", F.lit(1)).join(chunks.withColumn("__j", F.lit(1)), "__j").drop("__j")     # one row each
