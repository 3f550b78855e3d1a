"""Whitening against exact fractions and another eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from wordloom.llm import queries, whitening


def quantised(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def check(rows, vectors, components=32, near=1e-9):
    """rows of the operator against {id: vector}, for usable vectors of one length with different ids."""
    xs = {i: quantised(v) for i, v in vectors.items()}
    n, dim = len(xs), len(next(iter(xs.values())))
    sums = [sum(x[d] for x in xs.values()) for d in range(dim)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in xs.values()])
    cov = y.T @ y / n
    want = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, dim)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    assert {(r["vec_id"], r["component"]) for r in rows} == {(i, c) for i in xs for c in range(1, k + 1)}
    own = {(r["vec_id"], r["component"]): r for r in rows}
    for i, x in xs.items():
        assert own[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    w = np.array([[own[i, c]["whitened"] for c in range(1, k + 1)] for i in xs])
    explained = [own[next(iter(xs)), c]["explained"] for c in range(1, k + 1)]
    np.testing.assert_allclose(explained, want[:k] / np.trace(cov), rtol=near)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and np.abs(w.T @ w / n - np.eye(k)).max() == pytest.approx(errors.pop(), abs=near) and max(r["identity_error"] for r in rows) <= 10 * near
    # Whitened values come from unit eigenvectors: the covariance maps each onto itself times its eigenvalue.
    u = y.T @ w / n / np.sqrt(want[:k])
    np.testing.assert_allclose(np.linalg.norm(u, axis=0), 1, rtol=10 * near)
    np.testing.assert_allclose(cov @ u, u * want[:k], atol=near * want[0])


def test_query_matches_brute_force(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check(queries.op11_whitening(spark, sf_dir).collect(), vectors)


def test_small_eigenvalues(spark):
    """Eigenvalues over eight powers of ten, means far from zero."""
    rng = np.random.default_rng(4)
    base, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    data = rng.standard_normal((400, 8)) * np.logspace(4, 0, 8) @ base + 1e6
    vectors = {i: v for i, v in enumerate(data.tolist())}
    check(whitening.whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect(), vectors, near=1e-7)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64])
def test_jacobi(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    a = a @ a.T
    e, u = whitening.jacobi(a)
    np.testing.assert_allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-9)
    np.testing.assert_allclose(u @ np.diag(e) @ u.T, a, atol=1e-12 * np.abs(a).max() * n)
    pairs = sorted((int(p), int(q)) for ps, qs in whitening.rounds(n) for p, q in zip(ps, qs, strict=True))
    assert pairs == [(p, q) for p in range(n) for q in range(p + 1, n)]


def test_graded_matrix_is_accurate():
    """A scaled matrix keeps its small eigenvalues to all digits, where their size beside the largest is below rounding."""
    scale, core = np.array([1e10, 1.0, 1e-10]), np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    e, _ = whitening.jacobi(core * scale[:, None] * scale)
    minors = [np.linalg.det(core[:k, :k]) for k in (1, 2, 3)]
    np.testing.assert_allclose(e, [minors[0] * 1e20, minors[1] / minors[0], minors[2] / minors[1] * 1e-20], rtol=1e-9)


def test_scatter_is_exact():
    rng = np.random.default_rng(0)
    for most in (10, 10**5, 10**8, 2**40, 2**60):
        y = rng.integers(-most, most + 1, (70, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.scatter(y).tolist() == want


def test_hard_rows(spark):
    """Null vectors and entries, other lengths, repeated and null ids, huge entries, no spread, no rows."""
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.5]), (2, [0.9, -0.5]), (2, [0.9, -0.5]), (None, [3.0, 1.0]), (7, [0.0, 0.0])]
    bad = [(3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (8, [inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1e300, 0.0])]
    docs = spark.createDataFrame([(i, v, "x", 1.5) for i, v in good + bad], "vec_id long, embedding array<double>, component string, _v double")
    got = whitening.whiten(docs).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in good for _ in range(2))
    assert all(r["n"] == 5 and r["identity_error"] < 1e-12 for r in got)
    assert whitening.whiten(docs.limit(0)).count() == 0 and whitening.whiten(docs.where("embedding is null")).count() == 0
    flat = whitening.whiten(docs.where("vec_id = 2")).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-12
    large = whitening.whiten(spark.createDataFrame([(1, [2.0**50]), (2, [-(2.0**50)])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in large] == [None, None] and sorted(r["whitened"] for r in large) == [-1.0, 1.0]
    tie = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in tie} == {2}


def test_any_partitioning_gives_the_same_bits(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)))], "vec_id long, embedding array<double>")
    models = [whitening.fit(docs.repartition(k)) for k in (1, 7)]
    assert models[0].sums == models[1].sums and (models[0].components == models[1].components).all() and (models[0].eigenvalues == models[1].eigenvalues).all()
