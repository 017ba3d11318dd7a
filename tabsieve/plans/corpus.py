"""Corpus composites: cleanup (T1), chunking (T2/T3), page ingest (S12, F11,
T4), corpus catalogue (A31/T17) on ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, html_to_text
from ..operators.aggregates import first_per_key
from ..operators.chunk import chunk_documents
from ..operators.partitioning import spread
from ..sources.tables import Tables


def dirty_documents(t: Tables) -> DataFrame:
    """Documents with cleanup targets added (the table holds none): leading
    spaces, doubled sentence spaces, tripled newlines, a page-number line,
    ligatures and long dashes."""
    x = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".  ")), F.lit("\n"), F.lit("\n\n\n"))
    return spread(t.documents).select("doc_id", "source", F.concat(
        F.lit("  "), x, F.lit("\n\n\n\n7\nﬁnal ﬂow – and — end\n\n\n  ")).alias("text"))


def cleaned_documents(t: Tables) -> DataFrame:
    d = dirty_documents(t)
    return d.select("doc_id", "source", clean_text("text").alias("text"))


def clean(t: Tables) -> DataFrame:
    c = cleaned_documents(t)
    return c.select("doc_id", "text", F.length("text").alias("n_chars"))


def chunks(t: Tables) -> DataFrame:
    return chunk_documents(cleaned_documents(t), ["doc_id"], "text", 1000, 200)


def corpus(t: Tables) -> DataFrame:
    """Chunk corpus with metadata columns (type = document source, filename)."""
    ch = chunk_documents(cleaned_documents(t), ["doc_id", "source"], "text", 1000, 200)
    return ch.select(F.col("source").alias("type"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
                     "doc_id", "chunk_index", "n_chunks", "text")


def corpus_types(t: Tables) -> DataFrame:
    """Chunks and distinct files per type (null type -> 'unknown')."""
    c = corpus(t)
    return c.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("filename").alias("n_files"))


def corpus_files(t: Tables) -> DataFrame:
    """One row per file, taken from its first chunk (deterministic
    first-wins instead of an order-dependent dropDuplicates)."""
    f = first_per_key(corpus(t), "filename", "chunk_index", ["type", "n_chunks"])
    return f.select("filename", "type", "n_chunks")


def page_text(t: Tables) -> DataFrame:
    """S12 with the default HTML extractor, cleaned."""
    return spread(t.pages).select("page_id", "url", clean_text(html_to_text("html")).alias("text"))


def page_ingest(t: Tables) -> DataFrame:
    """T4: extract -> clean -> minimum-content check (F11, applied by the
    chunker so the extraction runs once) -> chunk -> metadata. The rejected
    pages are ``filters.min_content(page_text(t), "text", 100)[1]``."""
    ch = chunk_documents(page_text(t), ["page_id", "url"], "text", 1000, 200, min_chars=100)
    return ch.select("page_id", F.lit("page").alias("type"), F.col("url").alias("filename"),
                     "chunk_index", "n_chunks", "start", "end", "text")


def save_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist (doc, chunk, text, metadata, embedding) as Parquet."""
    corpus.write.mode(mode).parquet(path)


def load_corpus(spark, path: str) -> DataFrame:
    """Load a saved corpus."""
    return spark.read.parquet(path)


def append_corpus(chunks: DataFrame, path: str) -> None:
    """Append new chunks to an existing corpus; existing rows untouched."""
    chunks.write.mode("append").parquet(path)
