"""Groups inside tasks: runs of rows with an equal key, and what pairs of places join. Rows come dealt and sorted by key, so a group is whole in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Each run of rows with equal ``keys``, across batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e > s:
                if held and tuple(c[s] for c in columns) != before:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
                before = tuple(c[s] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places reaches by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low
