"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so their scatter is a matrix of whole numbers, summed up without rounding. Its characteristic
polynomial is found modulo many primes, one small task each, by reduction to Hessenberg form, and put together by the
Chinese remainder theorem. All its roots are real, so the changes of sign of its coefficients, moved to any point, count
the roots beyond that point exactly: the largest are isolated and narrowed down to far more digits than a double has.
Inverse iteration on the null space of the scatter less a root gives the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import query, read
from parlance.runtime import stored

SCALE = 1024
# Entries from here on are no long when scaled.
LARGEST = float(1 << 52)
# Bits of a limb, and rows whose products of limbs are summed as doubles without rounding.
LIMB, ROWS = 20, 1 << 12
# Binary places behind the point of a root of the scatter (more where a root is small), and digits of components.
PLACES, DIGITS = 128, 100
_LONG = 1 << 63


def usable(vector: str) -> Column:
    """Not null, and every entry a finite number whose whole number is a long."""
    fits = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST), F.lit(False))
    return F.coalesce(F.forall(vector, fits), F.lit(False))


def whole_numbers(column: pa.ListArray, dims: int) -> np.ndarray:
    """floor(1024 * entry), one row per vector."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return np.floor(values * SCALE).astype(np.int64)


def products(y: np.ndarray) -> dict[int, np.ndarray]:
    """The matrix of all sums of products of columns of at most ROWS rows, as {s: M}: the sum of M * 2^(LIMB * s).

    Numbers are cut into limbs, so that every sum of products of doubles is a whole number below 2^53.
    """
    limbs = []
    while True:
        high = y >> LIMB
        if not high.any() or (high == -1).all() or (np.abs(y) < 1 << LIMB).all():
            limbs.append(y.astype(np.float64))
            break
        limbs.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = high
    out: dict[int, np.ndarray] = {}
    for a, x in enumerate(limbs):
        for b, z in enumerate(limbs):
            out[a + b] = out.get(a + b, 0) + (x.T @ z).astype(np.int64)
    return out


def scatter(rows: DataFrame, vector: str, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of the whole numbers, and n times the sums of products less the products of sums (exact).

    Partitions send their sums, added up by Spark as decimals; the driver gets one number for each pair of dimensions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(dims + 1)
        total: dict[int, np.ndarray] = {}
        chunks = 0

        def taken() -> pa.RecordBatch:
            parts = [(np.full(len(upper[0]), s), *upper, m[upper]) for s, m in sorted(total.items())]
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
            return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["s", "i", "j", "value"])

        for batch in batches:
            y = whole_numbers(batch.column(0), dims)
            y = np.concatenate([np.ones((len(y), 1), np.int64), y], axis=1)
            for at in range(0, len(y), ROWS):
                for s, m in products(y[at:at + ROWS]).items():
                    total[s] = total.get(s, 0) + m
                chunks += 1
                if chunks == 128:
                    yield taken()
                    total, chunks = {}, 0
        yield taken()

    sums = rows.select(vector).mapInArrow(run, "s bigint, i bigint, j bigint, value bigint").groupBy("s", "i", "j").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    m = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in sums.collect():
        m[r["i"]][r["j"]] += int(r["value"]) << (LIMB * r["s"])
    n, total = m[0][0], m[0][1:]
    full = [[n * m[min(i, j) + 1][max(i, j) + 1] - total[i] * total[j] for j in range(dims)] for i in range(dims)]
    return n, total, full


def primes(count: int) -> list[int]:
    """The largest primes below 2^31."""
    small = [p for p in range(3, 46342, 2) if all(p % q for q in range(3, int(p ** 0.5) + 1, 2))]
    divisors, out, high = np.array(small), [], (1 << 31) + 1
    while len(out) < count:
        block = np.arange(high - 2, high - 2 - 20_000, -2)
        prime = np.ones(len(block), bool)
        for q in divisors:
            prime &= block % q != 0
        out += block[prime].tolist()
        high = int(block[-1])
    return out[:count]


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of the characteristic polynomial modulo ``p`` < 2^31, the highest first: reduction to Hessenberg
    form by similarities, then the recurrence over its leading minors."""
    h = matrix.copy()
    d = len(h)
    for m in range(1, d - 1):
        some = np.flatnonzero(h[m:, m - 1])
        if not len(some):
            continue
        i = m + int(some[0])
        h[[m, i]] = h[[i, m]]
        h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    # minors[k]: the polynomial of the leading k rows, the lowest coefficient first.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - h[k - 1, k - 1] * minors[k - 1] % p) % p
        factor, below = [], 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            factor.append(below * int(h[i - 1, k - 1]) % p)
        if factor:
            terms = np.array(factor)[:, None] * minors[k - 2::-1][:k - 1] % p
            minors[k] = (minors[k] - terms.sum(axis=0)) % p
    return minors[d][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, the highest first, of a matrix of whole numbers without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The mean of the products of k eigenvalues is at most the power of their mean.
    bound = max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    moduli = primes(2 * (bound.bit_length() + 1) // 61 + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            rest = [polynomial_modulo(np.array([[x % p for x in row] for row in shared.value]), p) for p in ps]
            yield pa.record_batch([pa.array(ps), pa.array(rest, pa.list_(pa.int64()))], ["p", "rest"])

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(tasks).mapInArrow(
        run, "p bigint, rest array<bigint>").collect()
    whole = 1
    for p in moduli:
        whole *= p
    out = [0] * (d + 1)
    for r in found:
        share = whole // r["p"]
        share *= pow(share % r["p"], -1, r["p"])
        out = [a + share * b for a, b in zip(out, r["rest"])]
    shared.destroy()
    return [x - whole if 2 * x > whole else x for x in (a % whole for a in out)]


def beyond(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are larger than ``at``: changes of sign of its coefficients
    about that point."""
    c = list(poly)
    for k in range(1, len(c)):
        for i in range(1, len(c) - k + 1):
            c[i] += at * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], wanted: int, places: int = PLACES) -> tuple[list[int], int]:
    """The largest positive roots, falling and as often as they occur, times 2^places, each rounded up; and places.

    A root is isolated by counting, then narrowed down by the polynomial's exact sign.
    """
    positive = len(poly) - 1 - next((i for i, c in enumerate(reversed(poly)) if c), 0)
    wanted = min(wanted, positive)
    if not wanted:
        return [], places
    scaled = [c << (places * i) for i, c in enumerate(poly)]
    # Minus the second coefficient is the sum of all roots.
    top = (-poly[1] << places) + 1
    counts = {0: positive, top: 0}

    def count(at: int) -> int:
        if at not in counts:
            counts[at] = beyond(scaled, at)
        return counts[at]

    def value(at: int) -> int:
        v = 0
        for c in scaled:
            v = v * at + c
        return v

    out = []
    for j in range(1, wanted + 1):
        # count(lo) >= j > count(hi)
        lo = max(a for a, n in counts.items() if n >= j)
        hi = min(a for a, n in counts.items() if n < j)
        while hi - lo > 1 and count(lo) - count(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if count(mid) >= j else (lo, mid)
        sign = value(hi) > 0
        while hi - lo > 1:
            mid = (lo + hi) // 2
            v = value(mid)
            if v == 0:
                hi = mid
                break
            lo, hi = (lo, mid) if (v > 0) == sign else (mid, hi)
        out.append(hi)
    if out[-1].bit_length() < places - 20:
        return largest_roots(poly, wanted, 2 * places)
    return out, places


def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthogonal unit vectors of the null space of ``matrix - root``, by inverse iteration in decimals."""
    d = len(matrix)
    m = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
    m[range(d), range(d)] -= root
    tiny = max(abs(x) for x in m.ravel()) * Decimal(10) ** (20 - DIGITS) or Decimal(1)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(m[i, k]))
        m[[k, pivot]] = m[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        m[k + 1:, k] /= m[k, k]
        m[k + 1:, k + 1:] -= np.outer(m[k + 1:, k], m[k, k + 1:])

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for i in range(1, d):
            x[i] -= m[i, :i].dot(x[:i])
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - (m[i, i + 1:].dot(x[i + 1:]) if i < d - 1 else 0)) / m[i, i]
        return x

    found: list[np.ndarray] = []
    for c in range(count):
        # Starts of no special direction.
        x = np.array([Decimal(1) / (7 * i * i + 3 * i * c + c * c + 2) for i in range(d)], dtype=object)
        for _ in range(4):
            for _ in range(2):
                for f in found:
                    x = x - f * f.dot(x)
            x = x / x.dot(x).sqrt()
            x = solved(x)
        for _ in range(2):
            for f in found:
                x = x - f * f.dot(x)
        found.append(x / x.dot(x).sqrt())
    return [list(f) for f in found]


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``components`` are rows; ``sums`` are of the whole numbers ``floor(1024 * entry)``."""

    dims: int
    n: int
    sums: list[int]
    variances: list[float]
    explained: list[float]
    components: np.ndarray


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The principal components of all usable vectors of the most frequent length (of several, the longest), by
    falling variance; those of variance zero are left out. None if there is no usable vector.

    Work beyond the sums over all rows depends on the length of the vectors only.
    """
    good = rows.filter(usable(vector))
    size = good.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if size is None or not size["dims"]:
        return None
    dims = size["dims"]
    n, sums, matrix = scatter(good.filter(F.size(vector) == dims), vector, dims)
    poly = characteristic_polynomial(rows.sparkSession, matrix)
    roots, places = largest_roots(poly, components)
    trace = sum(matrix[i][i] for i in range(dims))
    with localcontext() as context:
        context.prec = DIGITS
        exact = [Decimal(r) / (1 << places) for r in roots]
        found: list[list[Decimal]] = []
        for r in dict.fromkeys(exact):
            found += null_vectors(matrix, r, exact.count(r))
        variances, explained = [float(r / n / n) for r in exact], [float(r / trace) for r in exact]
        units = []
        for v in found:
            at = max(range(dims), key=lambda i: abs(v[i]))
            units.append([float(x if v[at] > 0 else -x) for x in v])
    return Whitening(dims, n, sums, variances, explained, np.array(units).reshape(len(units), dims))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row per row with a usable vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    A vector is usable if it is not null, all its entries are finite numbers below 2^52, and its length is the most
    frequent one; all other rows are left out. ``deviation`` is the sum of the squares of n times the whole number
    less the dimension's sum, null beyond a long. Components number from 1 by falling variance, of either sign: the
    entry of the largest size is positive. There are fewer where fewer have a variance at all, and no rows for one
    vector or an empty table. ``identity_error`` is measured on the whitened rows, written once. Keys may be null or
    repeated; other columns are ignored. Nothing but sums over pairs of dimensions goes through the driver.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    found = fit(rows, "vector", components)
    shape = f"vec_id {kind}, deviation bigint, w array<double>"
    if found is None or not len(found.components):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, "
                                                     "whitened double, explained double, identity_error double")
    dims, n, sums = found.dims, found.n, found.sums
    turned = found.components.T / np.sqrt(found.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(batch.column(1), dims)
            wide = 2 * n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
            from_mean = (y.astype(object) if wide >= _LONG else y) * n - np.array(sums, object if wide >= _LONG else np.int64)
            if wide ** 2 * dims >= _LONG:
                squares = [sum(int(x) ** 2 for x in row) for row in from_mean]
            else:
                squares = (from_mean ** 2).sum(axis=1).tolist()
            w = (from_mean / n).astype(np.float64) @ turned
            yield pa.record_batch([
                batch.column(0), pa.array([s if s < _LONG else None for s in squares], pa.int64()),
                pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())],
                ["vec_id", "deviation", "w"])

    white = stored(rows.filter(usable("vector") & (F.size("vector") == dims)).mapInArrow(run, shape))
    k = len(found.components)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # Spark's covariance of a population centres before it multiplies.
    cov = white.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*map(F.lit, found.explained))
    return white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


@query("op12_characteristic_whitening")
def _op12(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))
