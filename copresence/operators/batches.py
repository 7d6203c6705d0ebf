"""Arrow batches of rows that are sorted by a key, taken a whole key at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """First rows of the runs of equal keys, the first columns of a batch with rows."""
    new = np.zeros(batch.num_rows, bool)
    for i in range(keys):
        filled = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= filled[1:] != filled[:-1]
    new[0] = True
    return np.flatnonzero(new)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold all rows of their keys, with the first rows of each; only the rows of one key are held from batch to batch."""
    rest = None  # the last key's rows, whose end is not seen yet
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first = starts(batch, keys)
        if first[-1]:
            yield batch.slice(0, first[-1]), first[:-1]
        rest = batch.slice(first[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)
