"""Arrow batches in blocks of bytes, as a batch is bounded by its rows, however long their texts or arrays are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that are worked on at once; a longer value stands alone.
BLOCK_BYTES = 1 << 20


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose strings or lists in ``column`` have ``limit`` bytes at most together; a longer one stands alone."""
    values = batch.columns[column]
    wide = values.type.value_type.bit_width // 8 if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else 1
    size = pc.binary_length(values) if wide == 1 else pc.multiply(pc.list_value_length(values), wide)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
