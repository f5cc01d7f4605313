import math

import numpy as np
import pytest

from waymark.llm import whitening
from waymark.llm.entry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d", [1, 2, 3, 7, 16, 33])
def test_jacobi(d):
    rnd = np.random.default_rng(d)
    a = rnd.normal(size=(d, d))
    a = a + a.T
    values, vectors = whitening.jacobi_eigen(a)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix D B D with well conditioned B: each eigenvalue to nearly full relative accuracy."""
    scale = 10.0 ** np.arange(0, -10, -1)
    b = np.eye(10) + 0.1 * np.ones((10, 10))
    values, _ = whitening.jacobi_eigen(b * scale[:, None] * scale)
    from fractions import Fraction

    assert math.isclose(values.prod(), float(Fraction(2)) * (scale**2).prod(), rel_tol=1e-12)  # det(B) = 1 + 10 * 0.1
    assert values[-1] > 0 and values[-1] / scale[-1] ** 2 == pytest.approx(1, abs=0.2)


def test_jacobi_of_constant_and_diagonal():
    assert whitening.jacobi_eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.jacobi_eigen(np.diag([1.0, 3.0, 2.0]))[0].tolist() == [3, 2, 1]


def check(rows, vectors, components=16):
    """Rows of the query against numpy on all distinct grid vectors."""
    grid = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = sorted(set(map(tuple, grid.values())))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(x[k] * n - sums[k]) / n for k in range(d)] for x in fit])
    cov = centred.T @ centred / n
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1], u[:, ::-1]
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(grid)
    for i, x in grid.items():
        assert set(by[i]) == set(range(1, min(components, d) + 1))
        y = np.array([(x[k] * n - sums[k]) / n for k in range(d)])
        for k, r in by[i].items():
            assert r.n == n and r.deviation == sum((v * n - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert abs(abs(r.whitened) - abs(y @ u[:, k - 1] / math.sqrt(values[k - 1]))) < 1e-7
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
            assert r.identity_error <= 1e-9


def test_query_equals_numpy(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(QUERIES["op12_whitening"](spark, SF).collect(), vectors)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")


def test_rows(spark):
    good = [(1, [1.0, 2.0], "a"), (1, [3.0, -2.5], "b"), (None, [0.5, 0.25], "c"), (4, [1.0, 2.0], "d"), (4, [1.0, 2.0], "d"), (9, [1.25, 7.0], None)]
    bad = [(5, None, "e"), (6, [1.0, None], "f"), (7, [float("nan"), 1.0], "g"), (8, [float("inf"), 1.0], "h"), (10, [], "i"), (11, [1.0, 2.0, 3.0], "j"), (12, [1e30, 1.0], "k")]
    rows = whitening.whitened_components(whitening.on_grid(frame(spark, good + bad))).collect()
    assert sorted((r.vec_id or 0) for r in rows) == sorted(2 * [i or 0 for i, _, _ in good])
    assert {r.n for r in rows} == {4}
    alike = {(r.component, r.whitened, r.deviation) for r in rows if r.vec_id == 4} | {(r.component, r.whitened, r.deviation) for r in rows if r.vec_id == 1}
    assert len(alike) == 4  # two vectors under the ids 1 and 4
    assert whitening.whitened_components(whitening.on_grid(frame(spark, bad[:4]))).count() == 0
    assert whitening.whitened_components(whitening.on_grid(frame(spark, []))).count() == 0


def test_no_variance_and_huge(spark):
    rows = whitening.whitened_components(whitening.on_grid(frame(spark, [(1, [1.0, 5.0], ""), (2, [1.0, 6.0], ""), (3, [1.0, 6.0], "")]))).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True)}
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) for r in rows)
    one = whitening.whitened_components(whitening.on_grid(frame(spark, [(1, [1.0, 5.0], "")]))).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == 2 * [(1, 0, None, 0.0, 0.0)]
    far = whitening.whitened_components(whitening.on_grid(frame(spark, [(1, [2.0**40, 0.0], ""), (2, [-(2.0**40), 1.0], "")]))).collect()
    assert {r.deviation for r in far} == {None}
