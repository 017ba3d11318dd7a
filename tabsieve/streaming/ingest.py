"""Incremental corpus append (U3/T4) as a Structured Streaming job.

New document files landing in a folder are cleaned (T1) and chunked (T2)
and appended to the corpus table; the checkpoint folder (on shared storage)
records which files were processed, so a restarted or partially failed job
neither loses nor duplicates chunks. The transformations are the batch ones
unchanged: they are stateless per row/document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text
from ..operators.chunk import chunk_documents

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus_stream(spark: SparkSession, landing: str, schema: str = DOC_SCHEMA, size: int = 1000,
                  overlap: int = 200, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming frame of chunk rows from Parquet files landing in a folder."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(landing)
    cleaned = src.select("doc_id", "source", clean_text("text").alias("text"))
    ch = chunk_documents(cleaned, ["doc_id", "source"], "text", size, overlap)
    return ch.withColumn("ingested_at", F.current_timestamp())


def start_append(stream: DataFrame, corpus_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to the corpus table (Parquet file sink: exactly-once via the
    sink's own metadata log plus the checkpoint)."""
    w = stream.writeStream.format("parquet").option("path", corpus_path).option("checkpointLocation", checkpoint) \
              .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def corpus_status(spark: SparkSession, corpus_path: str) -> DataFrame:
    """Chunk and document counts plus the newest ingest time."""
    c = spark.read.parquet(corpus_path)
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"),
                 F.max("ingested_at").alias("last_ingest"))
