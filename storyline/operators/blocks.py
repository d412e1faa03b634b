"""Small array helpers that run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length list column as a float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def entry_rows(lists: pa.Array) -> np.ndarray:
    """Row number of every entry of a list column."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


#: Entries of a list column that are worked on at a time.
SLICE_ENTRIES = 1 << 18


def bounded_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_ENTRIES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` entries of a list column, or of one row.

    What is made of a slice is bounded by it, however many rows a batch has.
    """
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def best_per_row(
    scores: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` best columns per row: score first, then lowest id."""
    by_id = np.argsort(ids, kind="stable")
    left = scores[:, by_id] if allowed is None else np.where(allowed, scores, -np.inf)[:, by_id]
    every = np.arange(len(left))
    rows, cols = [], []
    # with columns in id order, the first maximum is the one with the lowest id
    for _ in range(min(k, left.shape[1])):
        col = left.argmax(axis=1)
        found = np.isfinite(left[every, col])
        if not found.any():
            break
        rows.append(every[found])
        cols.append(by_id[col[found]])
        left[every, col] = -np.inf
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def best_matrix(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` best columns per row as two rows x k matrices, padded."""
    best = np.full((len(scores), k), -np.inf)
    best_ids = np.full((len(scores), k), np.iinfo(np.int64).max)
    rows, cols = best_per_row(scores, ids, k)
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    best[rows, place] = scores[rows, cols]
    best_ids[rows, place] = ids[cols]
    return best, best_ids


def merge_best(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` per row of two such pairs of matrices."""
    k = a[0].shape[1]
    scores, ids = (np.concatenate([x, y], axis=1) for x, y in zip(a, b))
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = (np.take_along_axis(x, by_id, axis=1) for x in (scores, ids))
    by_score = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return tuple(np.take_along_axis(x, by_score, axis=1) for x in (scores, ids))
