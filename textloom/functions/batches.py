"""Arrow batches in smaller parts, so that a Python worker's memory depends neither on rows nor on the length of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or ids, that a Python worker takes at once.
SLICE = 1 << 20


def slices(whole: pa.RecordBatch | pa.Array, columns: list[pa.Array]) -> Iterator[pa.RecordBatch | pa.Array]:
    """Parts of a batch of 500 rows and about ``SLICE`` bytes of texts or items of lists at most; one long row is a part of its own."""
    lengths = [pc.fill_null(pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    for c, n in zip(columns, lengths):
        if pa.types.is_list(c.type) and pa.types.is_string(c.type.value_type):
            # words count by their characters
            n += np.diff(np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(c.flatten()), 0).to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(n)]]).astype(np.int64)
    total, first, size = sum(lengths).tolist(), 0, 0
    for i, n in enumerate(total):
        if i > first and (size + n > SLICE or i - first == 500):
            yield whole.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(total):
        yield whole.slice(first)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
