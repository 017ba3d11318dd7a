"""Documents in numbered blocks, for operators that ask the whole corpus
about what a block holds and need the answer back at the block.

A block is a run of consecutive documents of one scan task, bounded in
bytes; what its documents share is combined before anything is shuffled, so
a text or passage that a third of all documents hold leaves a block once.
The blocks are written once to the shared folder, so their numbers hold for
every later step and after the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partitioning import estimated_bytes
from .common import trimmed, written
from .words import runs, text_bytes

BLOCK_BYTES, MOST_BYTES = 4 << 20, 64 << 20
EVEN_BYTES = 32 << 30
SCHEMA = "block long, size long, ids binary, marks binary, offsets binary, texts binary"
NO_ID = np.iinfo(np.int64).max   # stands for a null doc_id, after all others


def pack(a: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes() if isinstance(a, np.ndarray) else a)


def unpack(b: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def unit_bytes(docs: DataFrame) -> int:
    """Text bytes of a block, and of a hash partition that blocks send their
    pieces to: ``BLOCK_BYTES`` up to ``EVEN_BYTES`` of input and from there
    with its square root, so that the pieces a block has for a partition stay
    as many while both numbers grow, up to ``MOST_BYTES`` (at about 256 times
    ``EVEN_BYTES``), which bounds a task's memory. Beyond, messages shrink
    to single pieces and what is sent grows in proportion to the input."""
    grown = BLOCK_BYTES * max(1.0, estimated_bytes(docs) / EVEN_BYTES) ** 0.5
    return int(min(MOST_BYTES, grown))


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(block, size in bytes, ids, marks, offsets, texts), the arrays
    compressed; a mark is the 64-bit hash of a text, by which its row is
    found again. Blocks hold ``unit_bytes`` by default; a document longer
    than that is a block of its own."""
    block_bytes = block_bytes or unit_bytes(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in runs(offsets, block_bytes):
                lo, hi = int(offsets[i]), int(offsets[j])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([hi - lo], pa.int64()), pa.array([pack(ids[i:j])], pa.binary()),
                    pa.array([pack(marks[i:j])], pa.binary()), pa.array([pack(offsets[i:j + 1] - lo)], pa.binary()),
                    pa.array([pack(np.ascontiguousarray(data[lo:hi]), 3)], pa.binary())], ["block", "size", "ids", "marks", "offsets", "texts"])
                number += 1
    return written(docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(partial(trimmed, write), SCHEMA), "blocks")


def read_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a block's row."""
    return unpack(row["ids"], np.int64), unpack(row["texts"]), unpack(row["offsets"], np.int64)
