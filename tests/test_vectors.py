import numpy as np
import pytest

from tallyvec.functions.vectors import best_of_block, unit_rows
from tallyvec.operators import factor, influence, search, tiles
from tallyvec.operators.dense import Dense, add_blocks
from tallyvec.operators.factor import (
    fill_rows,
    gram,
    orthonormalise,
    representation,
    sparse_dot,
    truncated_svd,
)
from tallyvec.operators.grid import meet
from tallyvec.operators.influence import distance_shifts
from tallyvec.operators.search import (
    cosine_search,
    knn_join,
    most_similar,
    similar_to_vector,
    sparse_cosine_search,
)
from tests.test_counting import matrix


def dense(spark, values, key="row"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} int, vec array<double>")


def array_of(df, n):
    rows = {r[0]: r[1] for r in df.collect()}
    width = len(next(iter(rows.values())))
    return np.array([rows.get(i, [0.0] * width) for i in range(n)])


def sparse(spark, values):
    return matrix(spark, [(int(i), int(j), values[i, j]) for i, j in zip(*values.nonzero())])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(50, 40)) @ np.diag(0.7 ** np.arange(40))
    values[rng.random(values.shape) < 0.4] = 0
    values[3], values[:, 5] = 0, 0
    return values


def test_products(spark, sample, monkeypatch):
    rng = np.random.default_rng(1)
    for dims in (3, 16, 35):
        right = rng.normal(size=(40, dims))
        got = sparse_dot(sparse(spark, sample), dense(spark, right, "col"), dims, 40)
        assert np.allclose(array_of(got, 50), sample @ right)
        monkeypatch.setattr(tiles, "MIN_BLOCK", 7)
        monkeypatch.setattr(tiles, "MAX_BLOCK", 7)
        monkeypatch.setattr(tiles, "TILE_ENTRIES", 11)
        for bound in (0, 1 << 20):
            monkeypatch.setattr(tiles, "BROADCAST_BYTES", bound)
            tiled = tiles.Tiles.build(sparse(spark, sample), "row", "col", 50, 40)
            assert tiled.tiles.count() > 6 * 7
            panels = tiled.dot(tiles.to_panels(dense(spark, right, "col"), dims), dims)
            assert np.allclose(array_of(tiles.from_panels(panels, dims), 50), sample @ right)


def test_gram_and_orthonormal_basis(spark):
    values = np.random.default_rng(2).normal(size=(30, 4))
    values[:, 3] = values[:, 0] * 2
    table = dense(spark, values).repartition(4)
    assert np.allclose(gram(table, 4), values.T @ values)
    basis, rank = orthonormalise(table, 4)
    assert rank == 3
    assert np.allclose(gram(basis, rank), np.eye(rank), atol=1e-10)


def test_svd(spark, sample):
    u, sigma, v = truncated_svd(sparse(spark, sample), 6, 50, 40)
    left, right = array_of(u, 50), array_of(v, 40)
    _, exact, vt = np.linalg.svd(sample)
    assert np.allclose(sigma, exact[:6], rtol=1e-8)
    assert np.allclose(right.T @ right, np.eye(6), atol=1e-9)
    assert np.allclose(left.T @ left, np.eye(6), atol=1e-9)
    assert np.allclose(np.abs((right * vt[:6].T).sum(axis=0)), 1, atol=1e-6)
    assert (right[np.abs(right).argmax(axis=0), np.arange(6)] > 0).all()

    for power in (0.5, 1.0, 0.0):
        wv, transformer = representation(u, sigma, v, power)
        projected = sparse_dot(sparse(spark, sample), transformer, 6, 40)
        assert np.allclose(array_of(projected, 50), array_of(wv, 50), atol=1e-9)

    again = truncated_svd(sparse(spark, sample).repartition(7), 6, 50, 40)
    assert np.allclose(array_of(again[2], 40), right, atol=1e-9)


def test_svd_of_low_rank_and_too_many_components(spark):
    values = np.outer(np.arange(1.0, 7.0), np.arange(1.0, 6.0))
    u, sigma, v = truncated_svd(sparse(spark, values), 3, 6, 5)
    assert np.isclose(sigma[0], np.linalg.norm(values)) and sigma[1:] == [0.0, 0.0]
    assert np.allclose(array_of(u, 6) @ np.diag(sigma) @ array_of(v, 5).T, values)
    with pytest.raises(ValueError):
        truncated_svd(sparse(spark, values), 5, 6, 5)


def test_fill_rows(spark):
    table = spark.createDataFrame([(1, [2.0])], "row int, vec array<double>")
    assert array_of(fill_rows(table, 3, 1), 3).tolist() == [[0.0], [2.0], [0.0]]


def brute(queries, items, k, drop_self):
    def unit(x):
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    sims = np.round(unit(queries) @ unit(items).T, search.SIM_DIGITS)
    out = {}
    for q in range(len(queries)):
        order = [i for i in np.lexsort((np.arange(len(items)), -sims[q])) if not (drop_self and i == q)]
        out[q] = order[:k] if k else order
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


@pytest.mark.parametrize("k", [1, 4, 100])
def test_cosine_search_both_ways(spark, monkeypatch, k):
    rng = np.random.default_rng(4)
    items = rng.integers(-2, 3, size=(70, 3)).astype(float)
    items[10], items[11] = 0, items[12]
    table = dense(spark, items, "idx").repartition(5)
    for drop in (True, False):
        want = brute(items, items, k, drop)
        assert found(cosine_search(table, table, 3, k, drop)) == want
        monkeypatch.setattr(search, "QUERY_BLOCK", 16)
        monkeypatch.setattr(search, "SCORE_CELLS", 64)
        assert found(cosine_search(table, table, 3, k, drop)) == want
        monkeypatch.setattr(search, "QUERY_BYTES", 0)
        assert found(cosine_search(table, table, 3, k, drop)) == want
        monkeypatch.undo()


def test_search_corner_cases(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "c", [0.0, 0.0])]
    wv = spark.createDataFrame(rows, "idx int, word string, vec array<double>")
    assert most_similar("nobody", wv, 2).count() == 0
    assert most_similar("a", wv, 2, 0, everything=False).count() == 0
    everything = [tuple(r) for r in most_similar("a", wv, 2, -1).orderBy("rank").collect()]
    assert [(r, w, round(s, 6)) for r, w, s in everything] == [(1, "b", 0.707107), (2, "c", 0.0)]
    assert [r["word"] for r in similar_to_vector([1.0, 0.0], wv, 1).collect()] == ["a"]
    assert [r["word"] for r in similar_to_vector([1.0, 0.0], wv, 1, 0).collect()] == ["b"]
    with pytest.raises(ValueError):
        similar_to_vector([1.0], wv)
    assert knn_join(wv.select("idx", "vec"), wv.select("idx", "vec"), 2, 5).count() == 6


def test_block_selection_keeps_ties_with_small_ids():
    scores, ids = best_of_block(np.array([[1.0, 2.0, 1.0, 1.0]]), np.array([3, 5, 7, 9]), 2)
    assert dict(zip(ids[0].tolist(), scores[0].tolist())) == {5: 2.0, 3: 1.0}


def test_sparse_cosine(spark):
    rng = np.random.default_rng(5)
    values = rng.random((12, 9))
    values[values < 0.5] = 0
    table = sparse(spark, values).withColumnRenamed("v", "pmi")
    want = brute(values, values, 3, True)
    assert found(sparse_cosine_search(table, table, 3)) == want


def test_distance_shifts(spark):
    rng = np.random.default_rng(6)
    plain, labelled = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    plain[7] = 0

    def sims(x):
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        return x @ x.T

    shift = np.sort(np.abs(sims(plain) - sims(labelled)), axis=1)
    for topk in (5, 100):
        want = shift[:, -topk:].mean(axis=1)
        got = distance_shifts(dense(spark, plain), dense(spark, labelled), 40, 3, topk)
        assert np.allclose([r["influence"] for r in got.orderBy("row").collect()], want)


def test_small_components_are_not_lost(spark):
    """Half a dozen powers of ten below the largest, components keep their values."""
    values = [10.0**-i for i in range(8)] + [5e-9] * 22
    table = spark.createDataFrame([(i, i, v) for i, v in enumerate(values)], "row int, col int, v double")
    u, sigma, v = truncated_svd(table, 8, 30, 30)
    assert np.allclose(sigma, values[:8], rtol=1e-6, atol=0)
    assert np.allclose(np.abs(array_of(u, 30)), np.eye(30)[:, :8], atol=1e-5)
    assert np.allclose(np.abs(array_of(v, 30)), np.eye(30)[:, :8], atol=1e-5)


def test_keys_in_one_batch_twice_add_up(spark):
    """A factor whose keys come twice, close together; the blocks had more vectors than keys before."""
    rows = [(k % 7, [float(k), 1.0]) for k in range(21)]
    packed = Dense.pack(spark.createDataFrame(rows, "key int, vec array<double>").coalesce(1), 2, 4, 2)
    got = {r["key"]: r["vec"] for r in packed.rows("key", "int").collect()}
    assert got == {k: [float(3 * k + 21), 3.0] for k in range(7)}


def test_sparse_cosine_of_many_cells(spark, monkeypatch):
    """More query cells than Spark puts in a batch, several sets of queries and many parts."""
    rng = np.random.default_rng(8)
    values = np.round(rng.random((300, 90)), 2)
    values[rng.random(values.shape) < 0.3] = 0
    values[17] = 0
    table = sparse(spark, values).withColumnRenamed("v", "pmi").coalesce(1)
    for size in (search.SPARSE_BYTES, 4_000 * search.CELL_BYTES):
        monkeypatch.setattr(search, "SPARSE_BYTES", size)
        monkeypatch.setattr(search, "SPARSE_QUERIES", 32)
        monkeypatch.setattr(search, "PART_ROWS", 70)
        assert found(sparse_cosine_search(table, table, 3, n_rows=300, n_cols=90, ids=spark.range(300).toDF("row"))) == brute(
            values, values, 3, True
        )


def test_a_product_moves_no_tiles(spark, sample, monkeypatch):
    """Panels of a factor that is too large to be sent at once; no partial result per pair of blocks is shuffled."""
    monkeypatch.setattr(tiles, "MIN_BLOCK", 7)
    monkeypatch.setattr(tiles, "MAX_BLOCK", 7)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 5 * 8 * 48)
    right = np.random.default_rng(9).normal(size=(40, 13))
    tiled = tiles.Tiles.build(sparse(spark, sample), "row", "col", 50, 40)
    blocks = tiles.n_blocks(40)
    factor = Dense.pack(dense(spark, right, "col"), blocks, -(-40 // blocks), 13)
    seen = []
    monkeypatch.setattr(tiles, "add_blocks", lambda parts, *sizes: seen.append(parts.count()) or add_blocks(parts, *sizes))
    product = tiled.times(factor)
    assert np.allclose(array_of(product.rows("row", "int"), 50), sample @ right)
    files = len(tiled.tiles.inputFiles())
    assert seen[0] <= 3 * (tiles.n_blocks(50) + files)


def test_a_large_factor_is_sent_in_panels(spark, sample, monkeypatch):
    """A factor over the limit is not joined, which shuffled a vector for each entry of the matrix."""
    monkeypatch.setattr(factor, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(factor, "sum_panels", None)
    right = np.random.default_rng(10).normal(size=(40, 5))
    got = sparse_dot(sparse(spark, sample), dense(spark, right, "col"), 5, 40, n_rows=50)
    assert np.allclose(array_of(got, 50), sample @ right)


def test_shifts_are_found_in_single_precision():
    """Few differences are computed exactly; all were before. Rows that come late may be the largest."""
    rng = np.random.default_rng(11)
    pairs = np.hstack([unit_rows(rng.normal(size=(3_000, 4))) for _ in range(2)])
    ids = np.arange(3_000)
    state = influence._Shifts(ids[:50], pairs[:50], 20)
    state._merge, merged = lambda n, merge=state._merge: merged.append(sum(len(r) for r, _ in state.waiting[n])) or merge(n), []
    for begin in range(0, 3_000, 100):
        list(state.add(ids[begin : begin + 100], pairs[begin : begin + 100]))
    batches = list(state.finish())
    got = np.sort(np.concatenate([b.column(1).to_numpy() for b in batches]).reshape(50, 20), axis=1)
    one, two = np.hsplit(pairs, 2)
    want = np.sort(np.abs(one[:50] @ one.T - two[:50] @ two.T), axis=1)[:, -20:]
    assert np.allclose(got, want, atol=1e-12) and sum(merged) < 50 * 3_000 // 3


def test_largest_differences_travel_as_one_row(spark, monkeypatch):
    """A task sends a row for each of its rows, not one for each difference; a row may have got many at once, or few in all."""
    sent = []
    monkeypatch.setattr(influence, "meet", lambda *args: sent.append(meet(*args)) or sent[-1])
    monkeypatch.setattr(influence, "WORD_BLOCK", 16)
    monkeypatch.setattr(influence, "SHIFT_CELLS", 16 * 5)
    rng = np.random.default_rng(12)
    plain, labelled = (unit_rows(rng.normal(size=(300, 3))) for _ in range(2))
    plain[40:], labelled[40:] = plain[:1], plain[:1]
    shift = np.sort(np.abs(plain @ plain.T - labelled @ labelled.T), axis=1)
    for topk in (1, 7, 1000):
        got = distance_shifts(dense(spark, plain), dense(spark, labelled), 300, 3, topk)
        assert np.allclose([r["influence"] for r in got.orderBy("row").collect()], shift[:, -topk:].mean(axis=1))
        rows = sent[-1].groupBy("row").count().collect()
        assert len(rows) == 300 and max(r["count"] for r in rows) <= 2 * spark.sparkContext.defaultParallelism
    assert [e - b for b, e in influence._even_runs(np.array([1, 1, 900, 2, 2]), 3)] == [2, 1, 2]
