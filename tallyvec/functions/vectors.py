"""Batch kernels over dense vectors, for use inside tasks."""

from __future__ import annotations

import numpy as np


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Scale the rows to length one; zero rows stay zero, so they are similar to nothing."""
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)


def merge_top(
    scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keep per row the ``k`` best of two candidate sets, by score and then smaller id."""
    scores = np.concatenate([scores, new_scores], axis=1)
    ids = np.concatenate([ids, new_ids], axis=1)
    if scores.shape[1] <= k:
        return scores, ids
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def best_of_block(
    scores: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per row, ``k`` entries of a score block that include its best ones, ties by smaller id.

    The ids must rise from left to right.
    """
    if scores.shape[1] <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    # All entries above the k-th score, then those equal to it from the left.
    above = scores > kth
    level = scores == kth
    room = k - above.sum(axis=1, keepdims=True)
    keep = above | (level & (np.cumsum(level, axis=1) <= room))
    columns = np.nonzero(keep)[1].reshape(-1, k)
    return np.take_along_axis(scores, columns, axis=1), ids[columns]


def merge_few(
    scores: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    new_scores: np.ndarray,
    new_ids: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """``merge_top`` for scattered candidates: entry i belongs to row ``rows[i]``.

    The rows must be sorted and every row of ``scores`` full.
    """
    touched, counts = np.unique(rows, return_counts=True)
    all_rows = np.concatenate([np.repeat(touched, k), rows])
    all_scores = np.concatenate([scores[touched].ravel(), new_scores])
    all_ids = np.concatenate([ids[touched].ravel(), new_ids])
    order = np.lexsort((all_ids, -all_scores, all_rows))
    starts = np.concatenate([[0], np.cumsum(counts + k)[:-1]])
    best = order[starts[:, None] + np.arange(k)]
    scores[touched], ids[touched] = all_scores[best], all_ids[best]
    return scores, ids
