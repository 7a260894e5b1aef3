import math
from fractions import Fraction

import numpy as np
import pytest

from civicmesh.llm import exact_spectrum as spectrum
from civicmesh.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def brute(vectors):
    """n, deviations and the covariance of x, by fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = [[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (r[j] - Fraction(s[j], n)) for r in x) / n) for j in range(d)] for i in range(d)]
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], np.array(v), x, s


def check(spark, vectors, most=32):
    rows = whitened(spark.createDataFrame([(i, [float(c) for c in v], "a", "b") for i, v in enumerate(vectors)], SCHEMA), most).collect()
    n, deviations, v, x, s = brute(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(most, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert set(got) == {(i, c) for i in range(n) for c in range(1, rank + 1)}
    w = np.array([[got[i, c]["whitened"] for c in range(1, rank + 1)] for i in range(n)]).reshape(n, rank)
    for (i, c), r in got.items():
        assert r["n"] == n and int(r["deviation"]) == deviations[i] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    if rank:
        assert np.abs(w.T @ w / n - w.mean(0)[:, None] * w.mean(0) - np.eye(rank)).max() < 1e-9
        gaps = [min([abs(values[c] - values[o]) for o in range(len(values)) if o != c] or [1.0]) for c in range(rank)]
        centred = np.array([[float(a - Fraction(b, n)) for a, b in zip(r, s, strict=True)] for r in x])
        for c in range(rank):
            if gaps[c] > 1e-3 * values[0]:  # else any vectors of the space
                plain = centred @ axes[:, c] / values[c] ** 0.5
                assert min(np.abs(w[:, c] - plain).max(), np.abs(w[:, c] + plain).max()) < 1e-6
    return rows


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    check(spark, rng.normal(size=(200, 7)) * np.arange(1, 8))
    check(spark, rng.normal(size=(50, 40)), most=32)


def test_repeated_and_missing_variances(spark):
    check(spark, [[1, 0, 5], [-1, 0, 5], [0, 1, 5], [0, -1, 5]])  # one variance twice, one direction without
    check(spark, [[1, 2, 3]] * 4)  # none at all
    check(spark, [[7.5]])
    check(spark, [[0.5, -0.25], [1.5, 3.0], [0.5, -0.25]])


def test_large_entries_are_exact(spark):
    check(spark, [[1e9, -3e9], [2e9, 5.5], [-7e9, 1e9], [0.0, 2.0]])
    check(spark, [[1e14, 1.0], [-1e14, 2.0], [3.0, 5e13]])


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [0.0, 1.0]), (None, [4.0, 4.0]), (5, None), (6, []), (7, [1.0, None]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, [1.0]), (11, [1e300, 1.0])]
    out = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r["n"] for r in out} == {4}
    assert whitened(spark.createDataFrame(rows[4:9], "vec_id long, embedding array<double>")).count() == 0
    assert whitened(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_polynomials_and_roots():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        a = rng.integers(-4, 5, (d + 1, d)).astype(object)
        m = (a.T @ a).tolist()
        primes = spectrum.primes_over(2 * spectrum.coefficient_bound(m))
        poly = spectrum.remaindered([spectrum.polynomial_mod(m, p) for p in primes], primes)
        assert poly == [round(v) for v in np.poly(np.array(m, float))]
    assert spectrum.square_free([1, -7, 16, -12]) == [1, -5, 6]  # (x - 2)^2 (x - 3)
    assert spectrum.roots_above([1, -7, 16, -12], 2, 0) == 1 and spectrum.roots_above([1, -7, 16, -12], 3, 1) == 3
    roots, _ = spectrum.isolated([1, -7, 16, -12, 0], 9)
    assert [r[3] for r in roots] == [1, 2]


def test_close_roots_keep_their_vectors():
    big = 10**9
    m = [[big, 1, 0], [1, big, 0], [0, 0, big + 3]]
    roots, q = spectrum.isolated(_characteristic(m), 3)
    got = [(float(e), v) for _, e, v in spectrum.components(m, q, roots, iter(range(3)), 3)]
    assert [e for e, _ in got] == [big + 3, big + 1, big - 1]
    assert [[round(abs(x), 12) for x in v] for _, v in got] == [[0, 0, 1], [0.707106781187, 0.707106781187, 0], [0.707106781187, 0.707106781187, 0]]


def _characteristic(m):
    primes = spectrum.primes_over(2 * spectrum.coefficient_bound(m))
    return spectrum.remaindered([spectrum.polynomial_mod(m, p) for p in primes], primes)
