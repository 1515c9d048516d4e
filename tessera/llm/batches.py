"""Groups of rows within a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by its first columns (integers), one table for each of their values; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[:, low].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def least_label(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index that each of 0 to n - 1 reaches along the links x[i] - y[i]."""
    label = np.arange(n)
    while len(x):
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, before[x])
        label = label[label]
        if (before == label).all():
            break
    return label
