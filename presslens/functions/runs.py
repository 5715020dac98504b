"""Sorted rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of ``batches``, which come sorted by the first one, cut so that all rows with one value of it stay together."""
    kept: list[list[np.ndarray]] = []  # rows that may go on: the last value's
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if kept and rows[0][-1] == kept[-1][0][-1]:
            kept.append(rows)
            continue
        rows = [np.concatenate(x) for x in zip(*kept, rows, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        kept = [[x[cut:] for x in rows]]
        if cut:
            yield [x[:cut] for x in rows]
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]
