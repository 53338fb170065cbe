"""All rows of one table against all rows of another, block by block in a grid of tasks.

Vectors are packed once into blocks of some hundred rows, one row of a written table each. The
blocks of either side are numbered and dealt in turn to the groups of a grid with ``g`` by ``h``
cells; a cell is a task, which holds its group of left blocks while its group of right blocks
streams past. So a left block travels ``h`` times and a right block ``g`` times, whatever the
number of blocks, and with ``t`` tasks the traffic of equal sides is twice the root of ``t`` times their
size: for a million rows of 100 dimensions (0.8 GB) and 250 tasks, 26 GB. The number of a cell is
its partition, so no two cells share a task and none is idle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.operators.tiles import list_matrix
from tallyvec.sources.stage import write_stage

# Vectors in a block.
BLOCK_BYTES = 128 << 10

# Left blocks that a task holds.
HELD_BYTES = 64 << 20

# Pairs of rows that a task compares, where there are more tasks than cores.
TASK_PAIRS = 1 << 32


@dataclass
class Blocks:
    """``table(block, ids, values)``: numbered blocks of rows, ids and vectors as bytes."""

    table: DataFrame
    n_blocks: int
    n_rows: int
    n_dims: int


def pack(rows: DataFrame, n_dims: int, prepare: Callable[[np.ndarray], np.ndarray], name: str) -> Blocks:
    """Pack ``rows(id, vec)`` with integer ids, each matrix of vectors passed through ``prepare``.

    The rows are computed once. The driver sees two numbers per partition.
    """
    height = max(1, BLOCK_BYTES // (8 * n_dims))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        ids, vectors = np.zeros(0, np.int64), np.zeros((0, n_dims))

        def block(n: int) -> pa.RecordBatch:
            order = np.argsort(ids[:n], kind="stable")
            cells = [[part], [place], [n], [ids[order].tobytes()], [prepare(vectors[order]).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, fields)], fields.names)

        for batch in batches:
            if batch.num_rows:
                ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
                vectors = np.concatenate([vectors, list_matrix(batch.column(1), n_dims)])
            while len(ids) >= height:
                yield block(height)
                ids, vectors, place = ids[height:], vectors[height:], place + 1
        if len(ids):
            yield block(len(ids))

    fields = pa.schema(
        [("part", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("vals", pa.binary())]
    )
    schema = "part int, place int, n long, ids binary, vals binary"
    written = write_stage(rows.mapInArrow(blocks, schema), name)
    parts = written.groupBy("part").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).collect()
    before, n_blocks = [], 0
    for part, count, _ in sorted(map(tuple, parts)):
        before.append((part, n_blocks))
        n_blocks += count
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    table = written.join(offsets, "part").select((F.col("before") + F.col("place")).alias("block"), "ids", "vals")
    return Blocks(table, n_blocks, sum(r["n"] for r in parts), n_dims)


def shape(left: Blocks, right: Blocks, cores: int, sent: int = 0) -> tuple[int, int]:
    """Groups of left and of right blocks: as many cells as there is work for, and as little traffic.

    That is near to square, unless a task gives back ``sent`` bytes for each of its left rows.
    """
    tasks = max(2 * cores, -(-left.n_rows * right.n_rows // TASK_PAIRS))
    least = -(-left.n_rows * left.n_dims * 8 // HELD_BYTES)
    square = round(math.sqrt(tasks * left.n_rows / max(1, right.n_rows) * (1 + sent / (8 * left.n_dims))))
    across = max(1, min(left.n_blocks, max(least, square)))
    return across, max(1, min(right.n_blocks, -(-tasks // across)))


def meet(left: Blocks, right: Blocks, start: Callable, schema: str, sent: int = 0) -> DataFrame:
    """Rows of ``schema`` from tasks that together let all left rows meet all right rows.

    ``start(ids, values)`` takes the left rows of a task and returns an object with
    ``add(ids, values)``, called for one right block after the other, and ``finish()``; both
    yield record batches. The ids of a block rise. ``sent`` is what a task gives back for a left row, in bytes, if it is much.
    """
    cores = left.table.sparkSession.sparkContext.defaultParallelism
    across, down = shape(left, right, cores, sent)
    n_left, n_right = left.n_dims, right.n_dims

    def copies(blocks: Blocks, side: int, times: int, cell: str) -> DataFrame:
        turn = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn")
        copied = blocks.table.select("block", "ids", "vals", turn)
        return copied.select(F.expr(cell).cast("int").alias("cell"), F.lit(side).alias("side"), "block", "ids", "vals")

    both = copies(left, 0, down, f"block % {across} * {down} + turn").unionByName(
        copies(right, 1, across, f"turn * {down} + block % {down}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, state = [], [], None
        for batch in batches:
            for i, side in enumerate(batch.column(0).to_pylist()):
                own = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                values = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64)
                if not side:
                    # Copied, as a batch's memory is used again.
                    ids.append(own.copy())
                    vectors.append(values.reshape(-1, n_left).copy())
                    continue
                if state is None:
                    state = start(np.concatenate(ids), np.concatenate(vectors)) if ids else False
                    ids, vectors = [], []
                if state:
                    yield from state.add(own, values.reshape(-1, n_right))
        if state:
            yield from state.finish()

    placed = both.repartitionById(across * down, "cell").sortWithinPartitions("side", "block")
    return placed.select("side", "ids", "vals").mapInArrow(run, schema)
