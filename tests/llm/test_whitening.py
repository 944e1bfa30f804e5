"""Whitening against numpy's eigensolver, and exact sums against Python's integers."""

import numpy as np
import pytest

from weftline.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component string"


def plain(vectors):
    x = np.floor(64 * vectors) + 1_000_000
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    return x.astype(np.int64), c, e[::-1], u[:, ::-1]


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 5)) * [3, 2, 1.2, 0.7, 0.2] @ np.linalg.qr(r.normal(size=(5, 5)))[0]
    wide = np.concatenate([base, base[:, :1] * 0 + 7, base[:, 1:2] * 0], axis=1)  # two dimensions do not vary
    return np.concatenate([wide, wide[:20]]).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", "c") for i, v in rows], SCHEMA)


def test_components_values_and_errors(spark, vectors):
    bad = [(1000, None), (1001, [None] * 7), (1002, [float("nan")] * 7), (1003, [float("inf")] * 7), (1004, [])]
    rows = [*enumerate(vectors), *bad, (None, vectors[0]), (3, vectors[3])]
    got = W.whiten(frame(spark, rows)).toPandas()
    good = np.concatenate([vectors, vectors[[0, 3]]])
    x, c, e, u = plain(good.astype(float))
    assert len(got) == 5 * len(good) and set(got.n) == {len(good)} and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained[:5], e[:5] / e.sum(), rtol=1e-10)
    for k in range(5):
        rows = got[(got.component == k + 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id")
        want = c[: len(vectors)] @ u[:, k] / np.sqrt(e[k])
        sign = np.sign(want @ rows.whitened.to_numpy())
        assert np.allclose(rows.whitened, sign * want, atol=1e-8)
    s = x.sum(axis=0)
    want = [int(((len(x) * v - s) ** 2).sum()) for v in x[: len(vectors)]]
    assert got[(got.component == 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == want


def test_lengths_are_lists_of_their_own_and_most_is_kept(spark):
    rows = [(i, [i, i * i % 7]) for i in range(20)] + [(100 + i, [i % 5]) for i in range(10)]
    got = W.whiten(frame(spark, rows), most=1).toPandas()
    assert len(got) == 30 and set(got[got.vec_id < 100].n) == {20} and set(got[got.vec_id >= 100].n) == {10}
    assert set(got.component) == {1} and np.allclose(got[got.vec_id >= 100].explained, 1)


def test_empty_equal_and_unusable_vectors_have_no_components(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert W.whiten(frame(spark, rows)).count() == 0


def test_sums_are_exact_where_doubles_are_not():
    y = np.array([[2**40 + 1, 3], [-(2**45), 5]], np.int64)
    assert W.exact_products(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in (0, 1)] for i in (0, 1)]
    small = np.random.default_rng(1).integers(-300, 300, (5000, 4))
    assert (W.exact_products(small) == small.T @ small).all()


def test_factor_and_rotation():
    r = np.random.default_rng(2)
    for d, rank in ((6, 6), (7, 3), (1, 1), (5, 0)):
        a = r.normal(size=(d, rank)) * np.logspace(0, -5, rank) if rank else np.zeros((d, 0))
        factor = W.pivoted_cholesky(a @ a.T)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a @ a.T, atol=1e-14)
        w = W.one_sided_jacobi(factor)
        e = np.sort((w * w).sum(axis=0))[::-1]
        assert np.allclose(e, np.linalg.svd(a, compute_uv=False)[:rank] ** 2, rtol=1e-6)
        assert np.abs(w.T @ w - np.diag(np.diag(w.T @ w))).max(initial=0) < 1e-14


def test_deviation_beyond_a_long_is_null(spark):
    rows = spark.createDataFrame([(1, [1e12]), (2, [0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in W.whiten(rows).collect()] == [None] * 3
