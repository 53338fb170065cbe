"""How far labels move the neighbourhoods of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.functions.vectors import unit_rows
from tallyvec.operators.grid import meet, pack

WORD_BLOCK = 2_048

# Differences computed at a time: few enough for the processor's cache.
SHIFT_CELLS = 1 << 20


class _Shifts:
    """The largest differences of the rows of a task, some thousand rows at a time.

    The difference of two similarities is one product of ``[plain, -labelled]`` and ``[plain, labelled]``. It is found in
    single precision with a margin; what may be among the largest is computed exactly, and merged when ``topk`` per row have come.
    """

    def __init__(self, ids: np.ndarray, pairs: np.ndarray, topk: int):
        begins, half = range(0, len(ids), WORD_BLOCK), pairs.shape[1] // 2
        signs = np.repeat([1.0, -1.0], half)
        self.ids = [ids[b : b + WORD_BLOCK] for b in begins]
        self.sides = [pairs[b : b + WORD_BLOCK] * signs for b in begins]
        self.single = [s.astype(np.float32) for s in self.sides]
        # Below any difference, so that the first ones all count.
        self.best = [np.full((len(i), topk), -1.0) for i in self.ids]
        self.floor = [np.full((len(i), 1), -1.0, np.float32) for i in self.ids]
        self.waiting = [[] for _ in self.ids]
        # More than products of single precision can be off, of vectors whose halves have length one.
        self.slack = 2 * (2 * half + 4) * 1.2e-7
        self.topk = topk
        # Written again and again: new memory takes longer than the product.
        self.near, self.large = np.empty(SHIFT_CELLS, np.float32), np.empty(SHIFT_CELLS, bool)

    def add(self, ids: np.ndarray, pairs: np.ndarray):
        single = pairs.astype(np.float32)
        for n, side in enumerate(self.sides):
            step = max(1, SHIFT_CELLS // len(side))
            for at in range(0, len(ids), step):
                some = pairs[at : at + step]
                shape = len(side), len(some)
                near = self.near[: len(side) * len(some)].reshape(shape)
                np.matmul(self.single[n], single[at : at + step].T, out=near)
                np.abs(near, out=near)
                large = np.greater_equal(near, self.floor[n], out=self.large[: near.size].reshape(shape))
                cells = np.flatnonzero(large)
                if not len(cells):
                    continue
                rows = cells // len(some)
                if len(cells) > near.size // 16:
                    found = np.abs(side @ some.T).ravel()[cells]
                else:
                    found = np.abs(np.einsum("ij,ij->i", side[rows], some[cells - rows * len(some)]))
                self.waiting[n].append((rows, found))
                if sum(len(r) for r, _ in self.waiting[n]) >= self.topk * len(side):
                    self._merge(n)
        return iter(())

    def _merge(self, n: int):
        best, waiting, self.waiting[n] = self.best[n], self.waiting[n], []
        if waiting:
            rows, shifts = (np.concatenate(c) for c in zip(*waiting))
            order = np.argsort(rows.astype(np.uint16 if len(best) <= 1 << 16 else np.int64), kind="stable")
            counts = np.bincount(rows, minlength=len(best))
            # Some rows at a time, so that one that has got many does not widen all.
            for begin, end in _even_runs(counts, self.topk):
                own = order[counts[:begin].sum() : counts[:end].sum()]
                place = np.arange(len(own)) - np.repeat(np.cumsum(counts[begin:end]) - counts[begin:end], counts[begin:end])
                table = np.full((end - begin, self.topk + int(counts[begin:end].max())), -1.0)
                table[:, : self.topk] = best[begin:end]
                table[rows[own] - begin, self.topk + place] = shifts[own]
                best[begin:end] = np.partition(table, table.shape[1] - self.topk, axis=1)[:, -self.topk :]
        self.floor[n] = (best.min(axis=1, keepdims=True) - self.slack).astype(np.float32)

    def finish(self):
        for n, ids in enumerate(self.ids):
            self._merge(n)
            rows, places = np.nonzero(self.best[n] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(self.best[n][rows, places])], ["row", "shift"])


class _PackedShifts(_Shifts):
    """The same, with the numbers of a row in one cell, and -1 where there are less than ``topk``."""

    def finish(self):
        for n, ids in enumerate(self.ids):
            self._merge(n)
            cells = [row.tobytes() for row in self.best[n]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cells, pa.binary())], ["row", "shifts"])


def _even_runs(counts: np.ndarray, topk: int) -> list[tuple[int, int]]:
    """Runs of rows whose largest count makes few empty cells, beside ``topk``."""
    most = max(4 * topk, 2 * int(counts.mean()))
    if counts.max() <= most:
        return [(0, len(counts))]
    cuts = np.flatnonzero(np.append(True, (counts[1:] > most) | (counts[:-1] > most))).tolist()
    return list(zip(cuts, [*cuts[1:], len(counts)]))


def _largest_of_rows(topk: int):
    """From ``(row, shifts)`` in order of the rows to ``(row, influence)``, the mean of each row's ``topk`` largest."""

    def mean(ids: np.ndarray, shifts: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        counts = np.diff(np.append(starts, len(ids)))
        means = np.empty(len(starts))
        for count in np.unique(counts).tolist():
            own = np.flatnonzero(counts == count)
            table = shifts[starts[own][:, None] + np.arange(count)].reshape(len(own), -1)
            table = np.partition(table, table.shape[1] - topk, axis=1)[:, -topk:]
            there = table >= 0
            means[own] = np.where(there, table, 0.0).sum(axis=1) / there.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(means)], ["row", "influence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shifts = np.zeros(0, np.int64), np.zeros((0, topk))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            new = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, topk)
            shifts = np.concatenate([shifts, new])
            # The last row may go on in the next batch.
            whole = int(np.searchsorted(ids, ids[-1]))
            if whole:
                yield mean(ids[:whole], shifts[:whole])
                ids, shifts = ids[whole:], shifts[whole:]
        if len(ids):
            yield mean(ids, shifts)

    return run


def distance_shifts(
    plain: DataFrame, labelled: DataFrame, n_rows: int, n_dims: int, topk: int = 100
) -> DataFrame:
    """``(row, influence)`` for two representations ``(row, vec)`` of the same rows.

    The influence is the mean of the ``topk`` largest absolute differences between the
    cosine distances of a row to all rows, itself included, in one space and in the other.

    Blocks of rows, with their vectors of both spaces, meet in a grid of tasks. A task
    keeps ``topk`` numbers for each row of its group, and sends them once, as one row.
    """
    kind = plain.dtypes[0][1]
    both = plain.toDF("row", "plain").join(labelled.toDF("row", "labelled"), "row").select(
        "row", F.concat("plain", "labelled").alias("vec")
    )

    def halves(values: np.ndarray) -> np.ndarray:
        return np.hstack([unit_rows(x) for x in np.hsplit(values, 2)])

    rows = pack(both, 2 * n_dims, halves, "shift-blocks")
    shifts = meet(rows, rows, lambda ids, pairs: _PackedShifts(ids, pairs, topk), "row long, shifts binary", 8 * topk)
    placed = shifts.repartition("row").sortWithinPartitions("row")
    means = placed.mapInArrow(_largest_of_rows(topk), "row long, influence double")
    return means.select(F.col("row").cast(kind), "influence")


def mean_influence(influences: DataFrame) -> DataFrame:
    """``(influence)``: the mean over all rows."""
    return influences.agg(F.avg("influence").alias("influence"))
