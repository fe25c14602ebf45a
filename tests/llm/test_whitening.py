import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from parlance.llm import whitening as W
from parlance.llm.catalog import queries

SHAPE = "vec_id bigint, embedding array<double>"


def exact_polynomial(m):
    """Faddeev and LeVerrier, in fractions; the highest coefficient first."""
    d, out = len(m), [Fraction(1)]
    a = [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        for i in range(d):
            a[i][i] += out[-1]
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][i] for i in range(d)) / k)
    return [int(x) for x in out]


def exact_scatter(vectors):
    x = [[floor(1024 * c) for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def vectors(n, d, seed=1, size=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * size).tolist()


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e7, 1e14])
def test_scatter_is_exact(spark, size):
    v = vectors(300, 5, size=size)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], SHAPE).repartition(3)
    n, s, m = W.scatter(df, "embedding", 5)
    assert (n, s, m) == exact_scatter(v)


def test_polynomial_is_exact(spark):
    for d in (1, 2, 3, 7):
        _, _, m = exact_scatter(vectors(40, d, seed=d))
        assert W.characteristic_polynomial(spark, m) == exact_polynomial(m)
    # Zeros below the diagonal, repeated and zero eigenvalues.
    for m in ([[2, 0, 0], [0, 2, 0], [0, 0, 0]], [[4, 0, 2], [0, 9, 0], [2, 0, 1]], [[0, 0], [0, 0]]):
        assert W.characteristic_polynomial(spark, m) == exact_polynomial(m)


def test_roots_of_known_polynomials():
    from_roots = lambda roots: [int(c) for c in np.poly1d(np.array(roots, dtype=object), True).coeffs]
    for roots in ([9, 4, 1], [5, 5, 5, 2, 0, 0], [1000001, 1000000, 3], [7]):
        found, places = W.largest_roots(from_roots(roots), 8)
        assert [Fraction(r, 1 << places) for r in found] == [r for r in roots if r]
    # x^2 - 4 x + 2: two and the root of two more or less; counted on both sides.
    found, places = W.largest_roots([1, -4, 2], 2)
    assert np.allclose([r / 2 ** places for r in found], [2 + 2 ** 0.5, 2 - 2 ** 0.5], rtol=1e-15)
    assert [W.beyond([1, -4, 2], a) for a in (0, 1, 4)] == [2, 1, 0]


def test_many_rows_sum_without_rounding():
    y = np.random.default_rng(5).integers(-(1 << 61), 1 << 61, size=(50, 3))
    got = sum(m.astype(object) * (1 << (W.LIMB * s)) for s, m in W.products(y).items())
    assert (got == y.astype(object).T @ y.astype(object)).all()


def checked(df, good, ids, components=8):
    """Against a plain covariance and its eigenvectors, in doubles."""
    rows = df.collect()
    x = np.array([[floor(1024 * c) + 100000 for c in v] for v in good], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    cov = np.cov((x - x.mean(axis=0)).T, bias=True).reshape(len(s), len(s))
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i in ids for c in range(1, k + 1))
    by = {}
    for r in rows:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
        assert r["n"] == n and r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    w = np.array([[by[c][i]["whitened"] for c in range(1, k + 1)] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    mine = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    assert np.allclose(w, mine * np.sign((w * mine).sum(axis=0)), atol=1e-5)
    assert [by[1][i]["deviation"] for i in ids] == [int(sum((n * int(a) - int(t)) ** 2 for a, t in zip(r, s))) for r in x]


def test_rows_against_plain_eigenvectors(spark):
    v = vectors(200, 12)
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []),
           (905, [1.0] * 5), (906, [1e300] * 12), (907, [-float("inf")] * 12)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + bad, SHAPE).repartition(4)
    checked(W.whiten(df), v, range(200))
    checked(W.whiten(df, components=3), v, range(200), 3)


def test_fewer_components_than_dimensions(spark):
    v = [[a, 2 * a, b, 0.5] for a, b in np.random.default_rng(3).normal(size=(60, 2)).tolist()]
    v = [[floor(1024 * a) / 1024, 2 * floor(1024 * a) / 1024, b, c] for a, _, b, c in v]
    checked(W.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], SHAPE)), v, range(60))


def test_equal_variances(spark):
    v = [[s * (i == j) for j in range(4)] for i in range(4) for s in (1.0, -1.0)]
    rows = W.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], SHAPE)).collect()
    assert len(rows) == 32 and all(r["identity_error"] < 1e-12 and r["explained"] == pytest.approx(0.25) for r in rows)


def test_components_close_together():
    """Two eigenvalues that agree to 24 digits: the components are still those of the exact matrix."""
    from decimal import Decimal, localcontext
    big = 10 ** 24
    m = [[2 * big + 1, 0, 1], [0, 2 * big, 0], [1, 0, 7]]
    roots, places = W.largest_roots(exact_polynomial(m), 3)
    with localcontext() as c:
        c.prec = W.DIGITS
        for r in roots:
            r = Decimal(r) / (1 << places)
            [x] = W.null_vectors(m, r, 1)
            assert max(abs(sum(a * b for a, b in zip(row, x)) - r * x[i]) for i, row in enumerate(m)) < Decimal(10) ** -30


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    df = W.whiten(spark.createDataFrame(rows, SHAPE))
    assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_keys_and_clashing_columns(spark):
    rows = [(k, [float(i), float(i * i % 7)], i, 2.0) for i, k in enumerate([None, None, "a", "a", "b"])]
    df = spark.createDataFrame(rows, "name string, v array<float>, n bigint, w double")
    out = W.whiten(df, "name", "v").collect()
    assert sorted((r["vec_id"] or "", r["component"]) for r in out) == sorted((k or "", c) for k, *_ in rows for c in (1, 2))


def test_large_numbers(spark):
    v = (np.random.default_rng(9).normal(size=(30, 3)) * 2.0 ** 45).tolist()
    rows = W.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], SHAPE)).collect()
    assert len(rows) == 90 and all(r["deviation"] is None and r["identity_error"] < 1e-9 for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    checked(queries()["op12_characteristic_whitening"](spark, sf), [r[1] for r in rows], [r[0] for r in rows])
