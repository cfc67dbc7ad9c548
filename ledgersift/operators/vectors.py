"""Arrow batches of ``array<double>`` columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """Rows of a list column; every list has the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def squared_distances(rows: np.ndarray, points: np.ndarray, codes: int = 0) -> np.ndarray:
    """Sums of squared differences, added in column order so equal inputs give equal bits.

    The last ``codes`` columns are numbers of levels (negative: none) and count as their one-hot columns do.
    """
    total = np.zeros((len(rows), len(points)))
    plain = rows.shape[1] - codes
    for j in range(plain):
        gap = rows[:, j, None] - points[None, :, j]
        gap *= gap
        total += gap
    for j in range(plain, plain + codes):
        a, b = rows[:, j, None], points[None, :, j]
        total += (a != b) * ((a >= 0).astype(float) + (b >= 0))
    return total


def pair_distances(rows: np.ndarray, points: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of squared differences of the listed pairs, with the bits of ``squared_distances``."""
    total = np.zeros(len(r))
    for j in range(rows.shape[1]):
        gap = rows[r, j] - points[c, j]
        gap *= gap
        total += gap
    return total


def slices(count: int, width: int, cells: int = 4_000_000):
    """Row ranges that keep a rows x width block within ``cells`` numbers."""
    step = max(1, cells // max(1, width))
    for at in range(0, count, step):
        yield slice(at, min(count, at + step))
