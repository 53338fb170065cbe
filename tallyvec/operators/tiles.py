"""Sparse matrices cut into tiles, for repeated products with dense factors.

Row and column indices are dealt out in turn to blocks, so that the frequent words, which
have the small indices, spread over all of them. A tile holds entries of one row block and
one column block, at most ``TILE_ENTRIES`` of them; denser pairs of blocks get several
tiles. Tiles are written once and stay where they are: a product sends the dense factor to them, as many of
its dimensions at a time as ``BROADCAST_BYTES`` hold, and reads the tiles again for each such panel. So what
is shuffled and written by a product is the result, not the matrix and not a partial result per pair of blocks.
No task holds more than a tile, a panel of the factor and a block of the result.

For products without tiles a dense factor ``(key, vec)`` travels as panels ``(key, panel, part)`` of ``PANEL``
dimensions: an aggregation with one sum per dimension of a panel is small enough for the
JVM to compile, one over all dimensions is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.operators.dense import PART_SCHEMA, Dense, add_blocks, list_matrix, part_row
from tallyvec.sources.stage import BROADCAST_BYTES, write_stage

PANEL = 16

TILE_ENTRIES = 65_536

# Numbers multiplied at a time, to stay within the processor's cache.
SLICE_CELLS = 120 << 10

# Block heights: small factors are cut finely, large ones into at most about 64 blocks
# until a block reaches the upper limit. A place in a block fits into 16 bits.
MIN_BLOCK, MAX_BLOCK = 4_096, 65_536

# Places as 16-bit numbers and values as doubles, in bytes that numpy reads in place.
TILE_SCHEMA = "out_block int, in_block int, r binary, c binary, v binary"


def n_blocks(n: int) -> int:
    height = min(MAX_BLOCK, max(MIN_BLOCK, n // 64))
    return max(1, -(-n // height))


def to_panels(dense: DataFrame, n_dims: int) -> DataFrame:
    """``(key, panel, part)`` of ``(key, vec)``; the last part may be short."""
    # As one SQL expression: a column object per dimension is slow to build.
    parts = [
        f"struct({i} AS panel, slice(vec, {start + 1}, {PANEL}) AS part)"
        for i, start in enumerate(range(0, n_dims, PANEL))
    ]
    return dense.selectExpr(dense.columns[0], f"inline(array({', '.join(parts)}))")


def sum_panels(parts: DataFrame, n_dims: int, weight: str | None = None) -> DataFrame:
    """Sum the parts per key and panel, each times ``weight``; short parts come out padded."""
    key, times = parts.columns[0], f"{weight} * " if weight else ""
    sums = [f"coalesce(sum({times}get(part, {d})), 0D)" for d in range(min(PANEL, n_dims))]
    return parts.groupBy(key, "panel").agg(F.expr(f"array({', '.join(sums)}) AS part"))


def from_panels(parts: DataFrame, n_dims: int) -> DataFrame:
    """``(key, vec)`` of ``(key, panel, part)``."""
    key = parts.columns[0]
    vectors = parts.groupBy(key).agg(
        F.expr("flatten(array_sort(collect_list(struct(panel, part))).part) AS vec")
    )
    return vectors.selectExpr(key, f"slice(vec, 1, {n_dims}) AS vec")


def _pack(batches):
    """Cut entries sorted by (out_block, in_block, r) into tiles."""

    def tile(rows):
        first = rows[0]
        kinds = {2: np.uint16, 3: np.uint16, 4: np.float64}
        arrays = [np.concatenate([x[i] for x in rows]).astype(kind) for i, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(first[0])], pa.int32()),
                pa.array([int(first[1])], pa.int32()),
                *[pa.array([a.tobytes()], pa.binary()) for a in arrays],
            ],
            ["out_block", "in_block", "r", "c", "v"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
        borders = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
        for begin, end in zip(borders[:-1], borders[1:]):
            while begin < end:
                here = (columns[0][begin], columns[1][begin])
                if held and (size >= TILE_ENTRIES or here != (held[0][0], held[0][1])):
                    yield tile(held)
                    held, size = [], 0
                take = min(end - begin, TILE_ENTRIES - size)
                held.append((*here, *[c[begin : begin + take] for c in columns[2:]]))
                size += take
                begin += take
    if held:
        yield tile(held)


@dataclass
class Tiles:
    """Tiles of a matrix, ready for products that give one vector per ``out`` index."""

    tiles: DataFrame
    out: str
    kind: str
    n_out: int
    n_in: int

    @staticmethod
    def build(cells: DataFrame, out: str, into: str, n_out: int, n_in: int) -> Tiles:
        """Tile ``cells(row, col, v)`` and write the tiles in order of the output blocks.

        Range partitioning keeps the tiles of a block together, so that few partial results
        arise, and still splits a block that holds much of the matrix.
        """
        outs, ins = F.lit(n_blocks(n_out)), F.lit(n_blocks(n_in))
        placed = cells.select(
            (F.col(out) % outs).cast("int").alias("out_block"),
            (F.col(into) % ins).cast("int").alias("in_block"),
            F.floor(F.col(out) / outs).cast("int").alias("r"),
            F.floor(F.col(into) / ins).cast("int").alias("c"),
            "v",
        )
        ordered = placed.repartitionByRange("out_block", "in_block", "r").sortWithinPartitions(
            "out_block", "in_block", "r", "c"
        )
        tiles = write_stage(ordered.mapInArrow(_pack, TILE_SCHEMA), f"tiles-{out}")
        return Tiles(tiles, out, cells.schema[out].dataType.simpleString(), n_out, n_in)

    def dot(self, panels: DataFrame, n_dims: int) -> DataFrame:
        """The panels of the product with a dense factor given as panels."""
        outs, ins = n_blocks(self.n_out), n_blocks(self.n_in)
        rows = from_panels(panels, n_dims)
        product = self.times(Dense.pack(rows, ins, -(-self.n_in // ins), n_dims))
        return to_panels(product.rows(self.out, self.kind), n_dims)

    def times(self, dense: Dense, name: str = "product") -> Dense:
        """The product with a dense factor, written.

        A panel of the factor's dimensions is broadcast; every task multiplies the tiles that it reads by it.
        Tiles lie in the order of the output blocks, so a block's sum is cut only where a task's tiles end.
        """
        outs, n_dims = n_blocks(self.n_out), dense.n_dims
        height = -(-self.n_out // outs)
        width = min(n_dims, max(1, BROADCAST_BYTES // (8 * dense.n_blocks * dense.height)))
        context, sent, parts = self.tiles.sparkSession.sparkContext, [], []
        for start in range(0, n_dims, width):
            sent.append(context.broadcast(dense.panel(start, min(start + width, n_dims))))
            parts.append(self.tiles.mapInArrow(_multiply(sent[-1], start, height), PART_SCHEMA))
        partial = reduce(DataFrame.union, parts)
        product = Dense(add_blocks(partial, outs, height, n_dims), outs, height, n_dims).written(name)
        for panel in sent:
            panel.destroy()
        return product


def _multiply(sent: Broadcast, start: int, height: int):
    """Tiles times a panel of the factor whose first dimension is ``start``, as parts of output blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, current, total, there = sent.value, None, None, None
        width = factor.shape[2]
        step = max(1, SLICE_CELLS // width)
        for batch in batches:
            out_blocks, in_blocks = (batch.column(j).to_pylist() for j in (0, 1))
            for i, (out, into) in enumerate(zip(out_blocks, in_blocks)):
                if out != current:
                    if current is not None:
                        yield part_row(current, start, there, total[there])
                    current, total, there = out, np.zeros((height, width)), np.zeros(height, bool)
                r, c = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint16) for j in (2, 3))
                v, block = np.frombuffer(batch.column(4)[i].as_buffer(), np.float64), factor[into]
                for begin in range(0, len(r), step):
                    rows = r[begin : begin + step]
                    starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
                    products = block.take(c[begin : begin + step], axis=0)
                    products *= v[begin : begin + step, None]
                    total[rows[starts]] += np.add.reduceat(products, starts, axis=0)
                    there[rows[starts]] = True
        if current is not None:
            yield part_row(current, start, there, total[there])

    return run
