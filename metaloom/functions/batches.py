"""Arrow batches in pieces that a Python worker can hold, whatever the session's batch sizes are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, rows: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most rows rows and most_bytes bytes of text; a longer row is a slice of its own."""
    if batch.num_rows <= rows and batch.nbytes <= most_bytes:
        if batch.num_rows:
            yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + rows]), most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end
