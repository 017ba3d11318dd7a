"""Arrow batches in pieces of bounded bytes.

Spark bounds an Arrow batch by rows and by bytes of its own format; what a
task derives from a batch (Python strings, products, copies) is several times
as large. Cut into pieces, a task holds the batch and what one piece gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose values in ``column`` (texts: bytes, lists:
    numbers) have together at most about ``most``; a longer value is alone
    or at the end of its piece."""
    values = batch.column(column)
    size = (pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length)(values)
    before = np.cumsum(1 + size.fill_null(0).to_numpy(zero_copy_only=False).astype("int64")) // most
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
