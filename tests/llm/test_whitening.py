"""Whitening against exact fractions and a floating-point eigensolver, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewright.llm import whitening

from test_llm import empty

SCHEMA = "vec_id long, embedding array<double>, component string, N int"


def run(spark, vectors, ids=None, most=32):
    ids = range(len(vectors)) if ids is None else ids
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    return whitening.whitening(df, most=most).collect()


def integers(v):
    return [math.floor(64 * Fraction(c)) + 1_000_000 for c in v]


def check(spark, vectors, most=32):
    """The rows of all vectors against plain exact arithmetic and numpy."""
    rows = run(spark, vectors, most=most)
    x = [integers(v) for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    m = np.array([[float(Fraction(sum(v[i] * v[j] for v in apart), n * n * n)) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(m)
    values, vectors_ = values[::-1], vectors_[:, ::-1].T
    k = max((r.component for r in rows), default=0)
    assert len(rows) == n * k and k == min(most, int((values > values[0] * 1e-9).sum()))
    z = np.zeros((n, k))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum(a * a for a in apart[r.vec_id])
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
    centred = np.array(apart, float) / n
    for j in range(k):
        if min(abs(values[j] - np.delete(values, j))) > values[0] * 1e-3:  # a component of its own
            want = centred @ vectors_[j] / math.sqrt(values[j])
            assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) < 1e-9
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-9
    return z, values


def test_against_exact_sums_and_numpy(spark):
    r = np.random.default_rng(4)
    mix = np.eye(12) + 0.4 * r.normal(size=(12, 12))
    check(spark, (r.normal(0, 0.4, (150, 12)) @ mix).tolist())
    check(spark, (r.normal(0, 0.4, (150, 40)) + 3).tolist())  # more directions than components


def test_fewer_vectors_than_directions_and_constant_ones(spark):
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (7, 20))
    v[:, 3] = 0.25
    z, _ = check(spark, v.tolist())
    assert z.shape[1] == 6
    doubled = np.concatenate([v[:, :4], v[:, :4]], 1)
    assert check(spark, doubled.tolist())[0].shape[1] == 3


def test_equal_eigenvalues(spark):
    """Plus and minus each axis: every direction has the same variance; one has twice as much."""
    unit = np.eye(6)
    z, values = check(spark, np.concatenate([unit, -unit]).tolist())
    assert z.shape[1] == 6 and np.allclose(values, values[0], rtol=1e-9)
    unit[2, 2] = 2
    assert check(spark, np.concatenate([unit, -unit]).tolist())[0].shape[1] == 6


def test_large_and_tiny_entries(spark):
    r = np.random.default_rng(6)
    v = r.normal(0, 1, (30, 5)) * [1e9, 1.0, 1e-1, 1e4, 1e6]
    rows = run(spark, v.tolist())
    x = [integers(c) for c in v.tolist()]
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = [sum((30 * a - s) ** 2 for a, s in zip(c, sums, strict=True)) for c in x]
    assert all(y.deviation == (far[y.vec_id] if far[y.vec_id] < 1 << 63 else None) for y in rows)
    assert any(y.deviation is None for y in rows)
    assert len(rows) == 150 and all(y.identity_error < 1e-7 for y in rows)


def test_rows_that_are_dropped_and_tables_without_a_component(spark):
    ok = [[0.5, 1.0], [1.5, -2.0], [1.5, -2.0], [0.0, 0.1]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0], [1.0]]
    rows = run(spark, bad + ok, ids=[9] * len(bad) + [1, 2, 2, None])
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in rows if r.vec_id) == [(False, i, c) for i in (1, 2, 2) for c in (1, 2) if i == 1] + [(False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2)]
    assert sum(r.vec_id is None for r in rows) == 2 and {r.n for r in rows} == {4}
    assert run(spark, [[1.0, 2.0]]) == [] and run(spark, [[1.0, 2.0]] * 3) == [] and run(spark, [None]) == []
    assert run(spark, [[1e300, 1.0], [-1e300, 2.0]])[0].n == 2
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert empty(whitening.whitening(empty(df))).count() == 0 and whitening.whitening(empty(df)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 7, 20])
def test_polynomial_and_roots(spark, d):
    r = np.random.default_rng(d)
    a = r.integers(-1000, 1000, (d, d + 3)).astype(object)
    m = a @ a.T
    poly = whitening.charpoly(spark, m)
    for x in (-7, 0, 3, 10**6):  # Bareiss: the determinant of x - m without fractions
        b, last = [[(x if i == j else 0) - int(m[i, j]) for j in range(d)] for i in range(d)], 1
        for k in range(d - 1):
            for i in range(k + 1, d):
                for j in range(k + 1, d):
                    b[i][j] = (b[i][j] * b[k][k] - b[i][k] * b[k][j]) // last
            last = b[k][k]
        assert sum(c * x**i for i, c in enumerate(poly)) == b[-1][-1]
    values = np.linalg.eigvalsh(m.astype(float))[::-1]
    for k in range(d):
        value, first, several = whitening.root(poly, k, int(m.trace()))
        assert (first, several) == (k, 1) and math.isclose(value / (1 << whitening.BITS), values[k], rel_tol=1e-7)


def test_gram_in_limbs():
    r = np.random.default_rng(1)
    y = r.integers(-(1 << 56), 1 << 56, (2100, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.gram(y).tolist() == want and whitening.gram(y >> 40).tolist() == [[sum(int(a >> 40) * int(b >> 40) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
