import numpy as np
import pytest

from feedlake.llm import whitening as W
from feedlake.llm.registry import op13_whitening

SCHEMA = "vec_id bigint, embedding array<double>, component string"


def reference(vectors):
    """n, deviations, eigenvalues and components by plain means."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, values[::-1], axes[:, ::-1], centred


def check(rows, vectors, k):
    n, deviations, values, axes, centred = reference(vectors)
    assert len(rows) == n and all(r.n == n for r in rows)
    assert [int(r.deviation) for r in rows] == deviations
    got = np.array([r.whitened for r in rows])
    assert got.shape == (n, k)
    np.testing.assert_allclose(rows[0].explained, values[:k] / values.sum(), rtol=1e-9)
    for i in range(k):
        want = centred @ axes[:, i] / np.sqrt(values[i])
        np.testing.assert_allclose(got[:, i] * np.sign(got[:, i] @ want), want, atol=1e-7)
    np.testing.assert_allclose(got.T @ got / n, np.eye(k), atol=1e-8)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("n, width, most", [(300, 12, 5), (200, 40, 32), (60, 3, 32), (9, 20, 4)])
def test_against_a_dense_solver(spark, n, width, most):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, width)) @ np.diag(np.linspace(1, 4, width)) + rng.standard_normal(width)).tolist()
    rows = sorted(W.whiten(frame(spark, vectors).repartition(3), most).collect(), key=lambda r: r.vec_id)
    check(rows, vectors, min(most, width))


def test_odd_rows(spark):
    good = [[0.5, -1.0], [2.0, 3.0], [2.0, 3.0], [-1e6, 0.25], [0.015625, 7.0]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(None, v, None) for v in odd]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(sorted(got, key=lambda r: r.vec_id), good, 2)
    one = W.whiten(spark.createDataFrame([(None, [1.0, 5.0], "x"), (7, [2.0, 1.0], "x"), (7, [2.0, 1.0], "x")], SCHEMA)).collect()
    assert sorted((r.vec_id is None, len(r.whitened)) for r in one) == [(False, 1), (False, 1), (True, 1)]


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], "x")], [(i, [3.0, 4.0], "x") for i in range(5)], [(1, None, "x")]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_far_entries_stay_exact(spark):
    vectors = [[1e9, 1.0], [-1e9, 2.0], [3.0, 4.0], [1e9 - 1 / 64, 0.0]]
    rows = W.whiten(frame(spark, vectors)).collect()
    n, deviations, *_ = reference(vectors)
    assert sorted(int(r.deviation) for r in rows) == sorted(deviations)
    assert len(W.whiten(frame(spark, [[3e38, 0.0], [1.0, 1.0], [2.0, 0.0]])).collect()) == 3


def spectra():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    for values in (np.ones(24), np.repeat([5.0, 4.0, 3.0], 8), 10.0 ** -np.arange(24), np.r_[np.arange(1, 6), np.zeros(19)], np.r_[1 + 1e-10 * np.arange(12), np.zeros(12)]):
        yield np.diag(values.astype(float))
        m = turn @ np.diag(values) @ turn.T
        yield (m + m.T) / 2


@pytest.mark.parametrize("matrix", list(spectra()))
def test_intervals_hold_every_eigenvalue(spark, matrix):
    values, axes = W.components(spark, matrix, 20)
    want = np.linalg.eigvalsh(matrix)[::-1]
    scale = np.abs(matrix).sum(axis=1).max()
    want = want[want > W.FLOOR * scale][:20]
    assert len(values) == len(want)
    np.testing.assert_allclose(values, want, atol=1e-13 * scale)
    np.testing.assert_allclose(matrix @ axes, axes * values, atol=1e-12 * scale)
    np.testing.assert_allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)


def test_inertia():
    rng = np.random.default_rng(4)
    for width in (1, 2, 7, 30):
        m = rng.integers(-2, 3, (width, width)).astype(float)
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in rng.uniform(values[0] - 1, values[-1] + 1, 20):
            assert W.inertia_above(m, shift) == (values > shift).sum()
    assert W.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and W.inertia_above(np.zeros((3, 3)), 0.0) == 0


def test_query_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, axes, centred = reference([r.embedding for r in table])
    got = op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == n * 32 and {r.component for r in got} == set(range(1, 33))
    by_row = {r.vec_id: d for r, d in zip(table, deviations)}
    assert all(by_row[r.vec_id] == r.deviation for r in got)
    for r in got:
        assert abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    for i in (0, 15, 31):
        w = np.array([r.whitened for r in sorted((r for r in got if r.component == i + 1), key=lambda r: r.vec_id)])
        want = centred @ axes[:, i] / np.sqrt(values[i])
        np.testing.assert_allclose(w * np.sign(w @ want), want, atol=1e-8)
