"""Float vectors out of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the commonest length among usable ones as a double matrix, and their row numbers.

    Usable: not null, without null or non-finite components, not empty. Rows of other lengths are given by ``ragged``.
    """
    rows = ragged(column)
    if not rows:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    lengths = np.array([len(x) for _, x in rows])
    most = np.bincount(lengths).argmax()
    at = np.array([i for (i, _), n in zip(rows, lengths) if n == most])
    return np.stack([x for (_, x), n in zip(rows, lengths) if n == most]), at


def ragged(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(row number, components as doubles) of the usable rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values.cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    n = np.diff(offsets)
    good = (n > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    return [(int(i), values[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(good)]
