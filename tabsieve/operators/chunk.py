"""Overlapping chunker with sentence-boundary snapping (T2) and chunk
metadata (T3).

The loop inside one document is sequential (each start depends on the
previous end), so parallelism is per document: ``mapInArrow`` runs the loop
on Arrow batches of documents inside each task and emits one row per chunk.
A batch is taken in pieces of about 1 MB of text, so that what a task holds
besides the batch does not grow with it.
A pure-expression fold would be interpreted per character and is far
slower. No shuffle is introduced; the output keeps the input partitioning.
"""

from __future__ import annotations

from itertools import pairwise
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_DELIMITERS
from .partitioning import spread
from .pieces import pieces

CHUNK_SCHEMA = "chunk_index int, n_chunks int, start int, end int, text string"


def boundary(text: str, start: int, size: int, overlap: int) -> int:
    """Where the window beginning at ``start`` ends: behind the last delimiter
    of the first kind (in priority order, quirk 20) that the window holds; at
    full size if it holds none, reaches the text's end, or would not let the
    next window begin later than this one (quirk 18)."""
    full = start + size
    if full >= len(text):
        return full
    found = ((text.rfind(d, start, full), len(d)) for d in SENTENCE_DELIMITERS)
    end = next((at + width for at, width in found if at >= 0), full)
    return end if end > start + overlap else full


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """All windows of a text longer than ``size``: each begins ``overlap``
    before the end of the one before."""
    span = (0, boundary(text, 0, size, overlap))
    while span[0] < len(text):
        yield span
        begin = span[1] - overlap
        span = (begin, boundary(text, begin, size, overlap))


def chunk_spans(text: str, size: int = 1000, overlap: int = 200, drop_suffix_tail: bool = False) -> list[tuple[int, int]]:
    """(start, end) offsets in code points. A text of at most ``size`` is one
    chunk. A last window that only repeats the end of the one before (quirk
    19) is kept unless ``drop_suffix_tail``."""
    if len(text) <= size:
        return [(0, len(text))]
    spans = list(windows(text, size, overlap))
    if drop_suffix_tail:
        spans = spans[:1] + [b for a, b in pairwise(spans) if a[1] < len(text)]
    return spans


def _chunker(id_cols: Sequence[str], text_col: str, size: int, overlap: int, drop_suffix_tail: bool,
             min_chars: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pieces(batch, text_col)):
            rows, spans, n, texts = [], [], [], []
            for r, text in enumerate(part.column(text_col).to_pylist()):
                if text is None or (min_chars and len(text.strip()) < min_chars):
                    continue
                found = chunk_spans(text, size, overlap, drop_suffix_tail)
                whole = len(text) <= size  # returned as is, not stripped
                rows += [r] * len(found)
                n += [len(found)] * len(found)
                spans += [(i, s, min(e, len(text))) for i, (s, e) in enumerate(found)]
                texts += [text if whole else text[s:e].strip() for s, e in found]
            ids = [part.column(c).take(pa.array(rows, pa.int64())) for c in id_cols]
            index, start, end = (pa.array([x[j] for x in spans], pa.int32()) for j in range(3))
            yield pa.RecordBatch.from_arrays([*ids, index, pa.array(n, pa.int32()), start, end, pa.array(texts, part.schema.field(text_col).type)],
                                             [*id_cols, "chunk_index", "n_chunks", "start", "end", "text"])
    return run


def chunk_documents(df: DataFrame, id_cols: Sequence[str], text_col: str = "text", size: int = 1000,
                    overlap: int = 200, drop_suffix_tail: bool = False, min_chars: int = 0) -> DataFrame:
    """One row per chunk: id columns + (chunk_index, n_chunks, start, end,
    text). Only the id and text columns travel to Python.

    ``min_chars`` (F11 inside the chunker): texts whose stripped length is
    below it give no chunks. A filter on a derived text column would be
    pushed below the repartition and the scan, evaluating the whole text
    derivation twice (once in the scan task); checked here, the text is
    derived once, in parallel. Python's ``str.strip`` uses the same
    whitespace set as ``text.py_strip``."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk size")
    id_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*id_cols).schema.fields)
    return spread(df.select(*id_cols, text_col)).mapInArrow(
        _chunker(list(id_cols), text_col, size, overlap, drop_suffix_tail, min_chars), f"{id_schema}, {CHUNK_SCHEMA}")


def with_chunk_metadata(chunks: DataFrame, type_value, filename, extra: dict | None = None,
                        out: str = "metadata") -> DataFrame:
    """Metadata map (type, filename, chunk_index, total_chunks) merged with
    caller metadata (e.g. source, upload_date)."""
    tv = type_value if not isinstance(type_value, str) else F.lit(type_value)
    fn = filename if not isinstance(filename, str) else F.col(filename)
    base = F.create_map(F.lit("type"), tv.cast("string"), F.lit("filename"), fn.cast("string"),
                        F.lit("chunk_index"), F.col("chunk_index").cast("string"),
                        F.lit("total_chunks"), F.col("n_chunks").cast("string"))
    if extra:
        kv = []
        for k, v in extra.items():
            kv += [F.lit(k), (v if not isinstance(v, str) else F.lit(v)).cast("string")]
        base = F.map_concat(base, F.create_map(*kv))
    return chunks.withColumn(out, base)
