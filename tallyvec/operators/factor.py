"""Sparse-dense products and the truncated SVD.

A dense factor is a table ``(key, vec ARRAY<DOUBLE>)``. The driver only ever holds
matrices of ``l x l`` numbers, with l the number of components plus the oversampling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvec.operators.dense import TRIANGLES, Dense, list_matrix, list_vectors, read_block
from tallyvec.operators.tiles import Tiles, from_panels, n_blocks, sum_panels, to_panels
from tallyvec.sources.stage import BROADCAST_BYTES, write_stage

# Fixed value: extra basis vectors of the randomised method.
OVERSAMPLE = 10

# Directions below this share of the largest one, times the dimensions, are rounding noise.
NOISE = 64 * float(np.finfo(np.float64).eps)


def sparse_dot(
    matrix: DataFrame,
    dense: DataFrame,
    n_dims: int,
    n_dense: int | None,
    row: str = "row",
    col: str = "col",
    value: str = "v",
    n_rows: int | None = None,
) -> DataFrame:
    """``(row, vec)``: the sparse matrix times ``dense(col, vec)``.

    A join on the column and one sum per dimension, combined map-side: a task ships one
    vector per row it saw, so neither long rows nor frequent columns pile up anywhere. The
    dimensions are handled in panels, which keeps the generated code small enough to be
    compiled. The dense side is broadcast only if its exact size allows it. Of a larger one, where rows are numbers
    below ``n_rows``, panels are sent to the tiles of the matrix: a join would shuffle a vector for each entry.
    """
    if n_rows and n_dense is not None and n_dense * n_dims * 8 > BROADCAST_BYTES:
        cells = matrix.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).alias("v"))
        tiles = Tiles.build(write_stage(cells, "dot-cells"), "row", "col", n_rows, n_dense)
        blocks = n_blocks(n_dense)
        right = Dense.pack(dense.select(dense.columns[0], "vec"), blocks, -(-n_dense // blocks), n_dims)
        return tiles.times(right.written("dot-factor"), "dot").rows(row, tiles.kind)
    right = to_panels(dense.select(F.col(dense.columns[0]).alias(col), "vec"), n_dims)
    if n_dense is not None and n_dense * n_dims * 8 <= BROADCAST_BYTES:
        right = F.broadcast(right)
    parts = matrix.join(right, col).select(row, "panel", "part", F.col(value).alias("weight"))
    return from_panels(sum_panels(parts, n_dims, "weight"), n_dims)


def triangle(dense: DataFrame, n_dims: int) -> np.ndarray:
    """R of a QR decomposition of a dense table, on the driver.

    Every task reduces its rows to one triangle, a second round of tasks reduces up to
    ``TRIANGLES`` of these, and the driver the few that remain. Unlike the square of the
    table, R keeps directions that are small beside the largest one.
    """

    def reduced(batches):
        held = np.zeros((0, n_dims))
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack([held, list_matrix(batch.column(0), n_dims)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([list_vectors(held)], ["vec"])

    parts = dense.select("vec").mapInArrow(reduced, "vec array<double>")
    # All rows of a triangle, or parts of it, may go anywhere: only their squares count.
    parts = parts.repartition(TRIANGLES).mapInArrow(reduced, "vec array<double>")
    rows = [r["vec"] for r in parts.collect()]
    return np.linalg.qr(np.array(rows).reshape(-1, n_dims), mode="r") if rows else np.zeros((1, n_dims))


def gram(dense: DataFrame, n_dims: int) -> np.ndarray:
    """``denseᵀ dense`` on the driver."""
    upper = triangle(dense, n_dims)
    return upper.T @ upper


def transform_rows(dense: DataFrame, factor: np.ndarray) -> DataFrame:
    """Multiply every vector of ``(key, vec)`` by a small matrix from the right."""
    key = dense.columns[0]
    n_dims = factor.shape[0]

    def multiply(batches):
        for batch in batches:
            block = list_matrix(batch.column(1), n_dims) @ factor
            yield pa.RecordBatch.from_arrays([batch.column(0), list_vectors(block)], [key, "vec"])

    kind = dense.schema[key].dataType.simpleString()
    return dense.select(key, "vec").mapInArrow(multiply, f"{key} {kind}, vec array<double>")


def _random_basis(keys: DataFrame, n_dims: int, seed: int) -> DataFrame:
    """A start basis that depends on key and seed only, not on the partitioning."""
    key = keys.columns[0]
    numbers = [f"xxhash64({key}, {d}, {seed}L) / {2**63}D" for d in range(n_dims)]
    return keys.selectExpr(key, f"array({', '.join(numbers)}) AS vec")


def _directions(upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a triangle and its right vectors, without those that are rounding noise."""
    _, values, vectors = np.linalg.svd(upper)
    present = values > len(vectors) * NOISE * values[0]
    return values[present], vectors[: len(values)][present].T


def orthonormalise(dense: DataFrame, n_dims: int, rounds: int = 2) -> tuple[DataFrame, int]:
    """Replace the columns of a written dense table by an orthonormal basis of their span.

    A second round removes the rounding error of the first.
    """
    factor = np.eye(n_dims)
    for _ in range(rounds):
        values, vectors = _directions(triangle(transform_rows(dense, factor), factor.shape[1]))
        factor = factor @ (vectors / values)
    return transform_rows(dense, factor), factor.shape[1]


def _span(dense: Dense, rounds: int = 1) -> Dense:
    """An orthonormal basis of a written factor; a second round removes the rounding error of the first."""
    factor = np.eye(dense.n_dims)
    for _ in range(rounds):
        values, vectors = _directions(dense.triangle(factor))
        factor = factor @ (vectors / values)
    return dense.times(factor)


def _sign_of_largest(dense: Dense) -> np.ndarray:
    """Per dimension, the sign of its entry of largest magnitude (first key on ties)."""
    n_dims, n_blocks = dense.n_dims, dense.n_blocks

    def partial(batches):
        best, keys, signs = np.full(n_dims, -1.0), np.zeros(n_dims, np.int64), np.ones(n_dims)
        dims = np.arange(n_dims)
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                slots, block = read_block(batch.column(1)[i], batch.column(2)[i], n_dims)
                if not len(slots):
                    continue
                ids, size = slots * n_blocks + number, np.abs(block)
                at = size.argmax(axis=0)
                top = size[at, dims]
                better = (top > best) | ((top == best) & (ids[at] < keys))
                best = np.where(better, top, best)
                keys = np.where(better, ids[at], keys)
                signs = np.where(better, np.sign(block[at, dims]), signs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims.astype(np.int32)), pa.array(best), pa.array(keys), pa.array(signs)],
            ["d", "size", "key", "sign"],
        )

    parts = dense.table.mapInArrow(partial, "d int, size double, key long, sign double")
    tops = parts.groupBy("d").agg(F.max_by("sign", F.struct("size", -F.col("key"))).alias("sign"))
    signs = np.ones(n_dims)
    for d, sign in tops.collect():
        signs[d] = sign if sign else 1.0
    return signs


def truncated_svd(
    matrix: DataFrame,
    n_components: int,
    n_rows: int,
    n_cols: int,
    n_iter: int = 5,
    seed: int = 0,
    value: str = "v",
) -> tuple[DataFrame, list[float], DataFrame]:
    """``U(row, vec)``, the singular values in falling order, and ``V(col, vec)``.

    Block subspace iteration from a fixed random start. A pass multiplies the basis by the
    matrix and the result by the transpose; after each of the two products the basis is made
    orthonormal, so that components far smaller than the largest are not lost. Rows and columns without entries are
    absent from the result, like zeros. Each column of V has a positive entry of largest
    magnitude.
    """
    if n_components >= n_cols:
        raise ValueError(
            f"n_components must be smaller than the number of columns, got {n_components} >= {n_cols}"
        )
    cells = write_stage(matrix.select("row", "col", F.col(value).alias("v")), "svd-cells")
    across = Tiles.build(cells, "row", "col", n_rows, n_cols)
    down = Tiles.build(cells, "col", "row", n_cols, n_rows)

    size = min(n_components + OVERSAMPLE, n_cols, n_rows)
    blocks = n_blocks(n_cols)
    start = _random_basis(cells.select("col").distinct(), size, seed)
    basis = Dense.pack(start, blocks, -(-n_cols // blocks), size)
    for step in range(n_iter + 1):
        # Between passes only the span matters.
        left = _span(across.times(basis, f"svd-left-{step}"))
        basis = _span(down.times(left, f"svd-basis-{step}"), rounds=2 if step == n_iter else 1)
    left = across.times(basis, "svd-left")

    sigma, rotation = _directions(left.triangle())
    sigma, rotation = sigma[:n_components], rotation[:, :n_components]
    rotation = rotation * _sign_of_largest(basis.times(rotation))
    u = left.times(rotation / sigma).rows("row", across.kind)
    v = basis.times(rotation).rows("col", down.kind)
    # A matrix of lower rank than asked for has zeros in the remaining dimensions.
    missing = n_components - len(sigma)
    if missing:
        u, v = _pad(u, missing), _pad(v, missing)
    return u, [*map(float, sigma), *[0.0] * missing], v


def _pad(dense: DataFrame, n: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), n)
    return dense.select(dense.columns[0], F.concat("vec", zeros).alias("vec"))


def scale_dims(dense: DataFrame, factors: list[float]) -> DataFrame:
    """Multiply each dimension of ``(key, vec)`` by its factor."""
    scaled = [f"get(vec, {d}) * {f!r}D" for d, f in enumerate(factors)]
    return dense.selectExpr(dense.columns[0], f"array({', '.join(scaled)}) AS vec")


def representation(
    u: DataFrame, sigma: list[float], v: DataFrame, power: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """``wv = U S^(1-power)`` and ``transformer = V S^(-power)``.

    Multiplying the factored matrix by the transformer gives the vectors, so trained and
    inferred rows share one space for any ``power``.
    """
    return (
        scale_dims(u, [s ** (1 - power) if s else 0.0 for s in sigma]),
        scale_dims(v, [s**-power if s else 0.0 for s in sigma]),
    )


def fill_rows(dense: DataFrame, n_rows: int, n_dims: int) -> DataFrame:
    """Add zero vectors for the missing keys below ``n_rows``."""
    key = dense.columns[0]
    kind = dense.schema[key].dataType
    keys = dense.sparkSession.range(n_rows).select(F.col("id").cast(kind).alias(key))
    zeros = F.array_repeat(F.lit(0.0), n_dims)
    return keys.join(dense, key, "left").select(key, F.coalesce("vec", zeros).alias("vec"))
