"""Dense factors as blocks of rows.

Keys are dealt out in turn: key ``k`` is in slot ``k // n`` of block ``k % n``. A block is one row
of a table, ``(block, seen, vals)``: a bit per slot that tells whether the key is there, and the
vectors of those that are, as bytes. So a factor passes from one product to the next as a
few rows that numpy reads in place. Parts of a block, ``(block, start, seen, vals)``, may hold some
of its dimensions only, those from ``start`` on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

BLOCK_SCHEMA = "block int, seen binary, vals binary"
PART_SCHEMA = "block int, start int, seen binary, vals binary"
_fields = pa.schema([("block", pa.int32()), ("seen", pa.binary()), ("vals", pa.binary())])
_parts = pa.schema([("block", pa.int32()), ("start", pa.int32()), *list(_fields)[1:]])

# Rows given back at a time.
SLICE_ROWS = 8_192

# Tasks that reduce the triangles of the tasks before them.
TRIANGLES = 16


def list_matrix(column: pa.Array, n_dims: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)


def list_vectors(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    n, k = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(k))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def block_row(block: int, seen: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One block: a mask over the slots, and the vectors of the slots that are seen."""
    cells = [[block], [np.packbits(seen).tobytes()], [np.ascontiguousarray(values).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _fields)], _fields.names)


def part_row(block: int, start: int, seen: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Part of a block: the dimensions from ``start`` on."""
    cells = [[block], [start], [np.packbits(seen).tobytes()], [np.ascontiguousarray(values).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _parts)], _parts.names)


def read_block(seen: pa.Scalar, vals: pa.Scalar, n_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a block's keys, and their vectors."""
    slots = np.flatnonzero(np.unpackbits(np.frombuffer(seen.as_buffer(), np.uint8)))
    return slots, np.frombuffer(vals.as_buffer(), np.float64).reshape(-1, n_dims)


def add_blocks(partial: DataFrame, n_blocks: int, height: int, n_dims: int) -> DataFrame:
    """The sum of the parts of the blocks of the same number; a task holds one sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, there = None, None, None
        for batch in batches:
            starts = batch.column(1).to_pylist()
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != current:
                    if current is not None:
                        yield block_row(current, there, total[there])
                    current, total, there = block, np.zeros((height, n_dims)), np.zeros(height, bool)
                slots = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)))
                if len(slots):
                    values = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(len(slots), -1)
                    total[slots, starts[i] : starts[i] + values.shape[1]] += values
                    there[slots] = True
        if current is not None:
            yield block_row(current, there, total[there])

    placed = partial.repartitionById(n_blocks, "block").sortWithinPartitions("block")
    return placed.mapInArrow(add, BLOCK_SCHEMA)


@dataclass
class Dense:
    """Blocks of a factor with ``n_dims`` columns; keys below ``n_blocks * height``."""

    table: DataFrame
    n_blocks: int
    height: int
    n_dims: int

    @staticmethod
    def pack(rows: DataFrame, n_blocks: int, height: int, n_dims: int) -> Dense:
        """Blocks of ``rows(key, vec)``; vectors of the same key add up."""

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = list_matrix(batch.column(1), n_dims)
                # Spark cuts batches as it likes, so one may hold a key twice.
                distinct, place = np.unique(keys, return_inverse=True)
                if len(distinct) < len(keys):
                    sums = np.zeros((len(distinct), n_dims))
                    np.add.at(sums, place, values)
                    keys, values = distinct, sums
                order = np.argsort(keys // n_blocks, kind="stable")
                order = order[np.argsort((keys % n_blocks)[order], kind="stable")]
                cuts = np.flatnonzero(np.diff((keys % n_blocks)[order], prepend=-1))
                for own in np.split(order, cuts[1:]):
                    there = np.zeros(height, bool)
                    there[keys[own] // n_blocks] = True
                    yield part_row(int(keys[own[0]] % n_blocks), 0, there, values[own])

        parts = rows.mapInArrow(single, PART_SCHEMA)
        return Dense(add_blocks(parts, n_blocks, height, n_dims), n_blocks, height, n_dims)

    def written(self, name: str) -> Dense:
        return Dense(write_stage(self.table, name), self.n_blocks, self.height, self.n_dims)

    def panel(self, start: int, stop: int) -> np.ndarray:
        """The dimensions from ``start`` to ``stop``, block by block, on the driver."""
        n_dims = self.n_dims

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    values = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64).reshape(-1, n_dims)
                    own = np.ascontiguousarray(values[:, start:stop]).tobytes()
                    cells = [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, _fields.names)

        found = np.zeros((self.n_blocks, self.height, stop - start))
        for row in self.table.mapInArrow(cut, BLOCK_SCHEMA).collect():
            slots = np.flatnonzero(np.unpackbits(np.frombuffer(row["seen"], np.uint8)))
            found[row["block"], slots] = np.frombuffer(row["vals"], np.float64).reshape(len(slots), -1)
        return found

    def times(self, factor: np.ndarray) -> Dense:
        """Every vector times a small matrix from the right."""
        n_dims = self.n_dims

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    values = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64).reshape(-1, n_dims)
                    cells = [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([(values @ factor).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, _fields.names)

        table = self.table.mapInArrow(multiply, BLOCK_SCHEMA)
        return Dense(table, self.n_blocks, self.height, factor.shape[1])

    def rows(self, key: str, kind: str) -> DataFrame:
        """``(key, vec)`` of the keys that are there."""
        n_dims, n_blocks = self.n_dims, self.n_blocks

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, block in enumerate(batch.column(0).to_pylist()):
                    slots, values = read_block(batch.column(1)[i], batch.column(2)[i], n_dims)
                    for begin in range(0, len(slots), SLICE_ROWS):
                        keys = slots[begin : begin + SLICE_ROWS] * n_blocks + block
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), list_vectors(values[begin : begin + SLICE_ROWS])], ["key", "vec"]
                        )

        out = self.table.mapInArrow(unpack, "key long, vec array<double>")
        return out.select(F.col("key").cast(kind).alias(key), "vec")

    def triangle(self, factor: np.ndarray | None = None) -> np.ndarray:
        """R of a QR decomposition, of the factor times a small matrix if one is given.

        Every task reduces its rows to one triangle, a second round of tasks reduces up to
        ``TRIANGLES`` of these, and the driver the few that remain. Unlike the square of the
        factor, R keeps directions that are small beside the largest one.
        """
        n_dims = self.n_dims
        width = n_dims if factor is None else factor.shape[1]

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((0, width))
            for batch in batches:
                for cell in batch.column(0):
                    values = np.frombuffer(cell.as_buffer(), np.float64).reshape(-1, n_dims)
                    held = np.linalg.qr(np.vstack([held, values if factor is None else values @ factor]), mode="r")
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["part"])

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((0, width))
            for batch in batches:
                parts = [np.frombuffer(c.as_buffer(), np.float64).reshape(-1, width) for c in batch.column(0)]
                held = np.linalg.qr(np.vstack([held, *parts]), mode="r")
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["part"])

        parts = self.table.select("vals").mapInArrow(first, "part binary")
        if self.n_blocks > 4 * TRIANGLES:  # there are no more triangles than blocks
            parts = parts.repartition(TRIANGLES).mapInArrow(again, "part binary")
        found = [np.frombuffer(r["part"], np.float64).reshape(-1, width) for r in parts.collect()]
        return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((1, width))
