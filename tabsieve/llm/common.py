"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

# A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_id_text(doc_id: Column) -> Column:
    """The id as text, for hashes; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model may learn from."""
    return F.crc32(doc_id_text(doc_id)) % 4 == 2


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh Parquet folder under the shared
    ``spark.checkpoint.dir`` and read back: later jobs read the files, which
    outlive any executor, instead of running the plan again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` over a task's batches; then the memory its arrays have freed
    goes back to the system. A worker serves task after task, and of small
    arrays the C library would keep about 100 MB in each, beside the JVM's
    memory. A C library without this call keeps what it does."""
    yield from work(batches)
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Makes sure of the shared folder and of this package on local workers.
    Where the session has the default size of Arrow batches (10,000 rows),
    documents travel in batches of 1,000: whole texts are wide rows."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table cut from its lineage by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def power_of_two(n: float) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def hash_cell(hashed: Column, cells: int) -> Column:
    """Which of ``cells`` (a power of two) equal ranges of the unsigned
    64-bit hash values holds this one: its leading bits."""
    bits = cells.bit_length() - 1
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a null column for each named column that ``df`` lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
