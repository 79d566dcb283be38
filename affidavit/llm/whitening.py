"""Whitening of embeddings by principal components that come from an exact polynomial.

1. Components become integers ``x = floor(1024 c) + 100000``.  Tasks sum them and
   their products exactly; with n vectors and sums S the scatter
   ``A = n * sum(x x') - S S'`` is an integer matrix, n squared times the covariance.
   (A offset common to all x leaves A as it is, so products are summed without it.)
2. The characteristic polynomial of A: modulo each of many 31-bit primes A is
   reduced to Hessenberg form and the polynomial read off by its recurrence, a
   prime at a time in Spark tasks; Chinese remaindering puts the coefficients
   together.  A has no negative eigenvalue, so by Maclaurin's inequality the k-th
   elementary symmetric function is at most ``C(d, k) * (trace / d) ** k``: primes are
   taken until their product passes that bound.
3. All roots are real, so by Descartes' rule the sign changes of the polynomial
   shifted by a number count the roots above it, with multiplicity.  Bisection with
   that count isolates the greatest roots, to ``BITS`` bits of the trace; an isolated
   root is narrowed further by the polynomial's sign alone.
4. A component is the null space of ``A - root``, by inverse iteration in decimal
   arithmetic of ``DIGITS`` digits; roots nearer to each other than double precision
   shows share a null space and get an orthonormal basis of it.  Each null space is
   a task of its own.

What reaches the driver depends on the dimension d alone: d * d sums, and d
coefficients for each prime (of which there are about d).

Defined cases: vectors that are null, empty or hold null or non-finite components
are dropped; vectors of different lengths are an error; null ids, repeated rows and
ties are rows like any other; a component of eigenvalue zero (vectors that lie in
fewer dimensions, or one vector alone) has null for whitened and is left out of
identity_error, which is null if none is left, as explained is if the trace is
zero; further columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions
from .integers import IN_FLOAT, IN_LONG, decimals, finite_vectors, floors, largest

FACTOR, OFFSET, MOST = 1024, 100_000, 8
#: Bits of the trace to which roots are found, digits of the inverse iteration, its steps, bits within which roots are one.
BITS, DIGITS, STEPS, ONE = 192, 120, 4, 96


@dataclass(frozen=True)
class Whitening:
    """n vectors, their sums without the offset, the components as columns, their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float | None]

    @property
    def used(self) -> np.ndarray:
        """Places of the components that have an eigenvalue above zero."""
        return np.flatnonzero(self.eigenvalues > 0)


def products(y: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, as Python integers."""
    most = largest(y) ** 2 * max(1, len(y))
    if most < IN_FLOAT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < IN_LONG:
        return (y.T @ y).astype(object)
    y = y.astype(object)
    return y.T @ y


def moments(vectors: DataFrame, vector: str, factor: int) -> tuple[int, list[int], np.ndarray]:
    """How many vectors count, the sums of their integers, and the sums of their products."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, None, None
        for b in batches:
            _, x = finite_vectors(b.column(0))
            if not len(x):
                continue
            y = floors(x, factor)
            if n and len(sums) != y.shape[1]:
                raise ValueError(f"vectors of different lengths: {sorted((len(sums), y.shape[1]))}")
            s, q = y.astype(object).sum(0), products(y)
            n, sums, square = n + len(y), s if sums is None else sums + s, q if square is None else square + q
        if n:
            d = len(sums)
            i, j = np.tril_indices(d)
            none = np.full(d, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([i, np.arange(d)]), pa.int32()), pa.array(np.concatenate([j, none]), pa.int32()),
                    pa.array(np.full(len(i) + d, n), pa.int64()), decimals(np.concatenate([square[i, j], sums])),
                ],
                ["i", "j", "n", "total"],
            )

    found = vectors.select(F.col(f"`{vector}`").alias("v")).mapInArrow(work, "i int, j int, n long, total decimal(38,0)")
    rows = found.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not rows:
        return 0, [], np.zeros((0, 0), object)
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    d = max(r.i for r in rows) + 1
    sums, square = [0] * d, np.zeros((d, d), object)
    for r in rows:
        if r.j < 0:
            sums[r.i] = int(r.total)
        else:
            square[r.i, r.j] = square[r.j, r.i] = int(r.total)
    return rows[0].n, sums, square


def primes_below(top: int) -> Iterator[int]:
    """Primes under ``top``, which is at most 2 ** 31, in falling order."""
    sieve = np.ones(1 << 16, bool)
    sieve[:2] = False
    for k in range(2, 256):
        if sieve[k]:
            sieve[k * k :: k] = False
    small = np.flatnonzero(sieve)
    while top > 2:
        low = max(2, top - (1 << 14))
        some = np.ones(top - low, bool)
        for p in small[small * small < top].tolist():
            some[max(p * p, -(-low // p) * p) - low :: p] = False
        yield from (low + np.flatnonzero(some)[::-1]).tolist()
        top = low


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p whose entries below the first subdiagonal are zero."""
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            a[[r, k + 1]] = a[[k + 1, r]]
            a[:, [r, k + 1]] = a[:, [k + 1, r]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - f[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * f % p).sum(1)) % p
    return a


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of the characteristic polynomial, the leading one last."""
    d = len(a)
    h = hessenberg((a % p).astype(np.int64), p)
    q = np.zeros((d + 1, d + 1), np.int64)
    q[0, 0] = 1
    below = np.zeros(0, np.int64)  # products of the subdiagonal from each row down to the last one
    for m in range(1, d + 1):
        q[m, 1:] = q[m - 1, :-1]
        q[m] = (q[m] - h[m - 1, m - 1] * q[m - 1] % p) % p
        if m > 1:
            below = np.append(below, 1) * h[m - 1, m - 2] % p
            factor = h[: m - 1, m - 1] * below % p
            q[m] = (q[m] - (factor[:, None] * q[: m - 1] % p).sum(0)) % p
    return q[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of ``det(t - a)`` of a matrix of integers without negative eigenvalues, the leading one last."""
    d = len(a)
    mean = sum(int(a[i, i]) for i in range(d)) // d + 1
    bound, product, primes = max(comb(d, k) * mean**k for k in range(d + 1)), 1, []
    for p in primes_below(1 << 31):
        if product > bound:
            break
        primes.append(p)
        product *= p

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [polynomial_modulo(a, p).tolist() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "rest"])

    tasks = min(len(primes), 4 * partitions(spark))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(work, "p long, rest array<long>").collect()
    total = [0] * (d + 1)
    for r in rows:
        rest = product // r.p
        unit = rest * pow(rest, -1, r.p)
        for k, c in enumerate(r.rest):
            # the k-th coefficient has the sign of (-1) ** (d - k), so without it none is below zero
            total[k] += (c if (d - k) % 2 == 0 else -c) % r.p * unit
    return [t % product * (-1) ** (d - k) for k, t in enumerate(total)]


def shifted(c: list[int], by: int) -> list[int]:
    """Coefficients of the polynomial at ``t + by``."""
    c = list(c)
    for k in range(len(c) - 1):
        c[k:] = list(accumulate(reversed(c[k:]), lambda high, low: high * by + low))[::-1]
    return c


def changes(c: list[int]) -> int:
    """Sign changes along the coefficients, zeros left out."""
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs[:-1], signs[1:], strict=True))


def greatest_roots(c: list[int], most: int, bits: int = BITS) -> tuple[list[int], int]:
    """(whole numbers m, s): the greatest positive roots, with multiplicity and falling, lie in ``(m, m + 1]`` over ``2 ** s``."""
    d = len(c) - 1
    s = max(0, bits - abs(c[d - 1]).bit_length())
    c = [x << (s * (d - k)) for k, x in enumerate(c)]
    top = abs(c[d - 1])  # the sum of the roots
    above = {0: changes(c), top: 0}  # no root is greater than the sum of all
    found = []
    for k in range(1, min(most, above[0]) + 1):
        low, high = max(m for m, n in above.items() if n >= k), min(m for m, n in above.items() if n < k)
        while high - low > 1 and not (above[low] == k and above[high] == k - 1):
            mid = (low + high) // 2
            above[mid] = changes(shifted(c, mid))
            low, high = (mid, high) if above[mid] >= k else (low, mid)
        while high - low > 1:  # a single root: the sign tells its side
            mid, value = (low + high) // 2, 0
            for x in reversed(c):
                value = value * mid + x
            low, high = (mid, high) if value and (value > 0) != (k % 2 == 1) else (low, mid)
        found.append(low)
    return found, s


def null_space(a: list[list[int]], root: Decimal, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that ``a - root`` takes to zero, or nearly."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        d = len(a)
        m = [[Decimal(x) - root if i == j else Decimal(x) for j, x in enumerate(row)] for i, row in enumerate(a)]
        tiny = max(abs(x) for row in m for x in row) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        order, steps = list(range(d)), []
        for k in range(d):
            r = max(range(k, d), key=lambda i: abs(m[i][k]))
            m[k], m[r], order[k], order[r] = m[r], m[k], order[r], order[k]
            for f in steps:
                f[k], f[r] = f[r], f[k]
            if abs(m[k][k]) < tiny:
                m[k][k] = tiny
            tail, column = m[k][k + 1 :], [Decimal(0)] * d
            for i in range(k + 1, d):
                if m[i][k]:
                    f = column[i] = m[i][k] / m[k][k]
                    m[i][k + 1 :] = [x - f * y for x, y in zip(m[i][k + 1 :], tail, strict=True)]
            steps.append(column)
        found: list[list[Decimal]] = []
        for j in range(count):
            v = [Decimal((1 + i * 7919 + (i + 3) * (j + 1) * 104729) % 1009 + 1) for i in range(d)]
            for _ in range(STEPS):
                v = [v[i] for i in order]
                for k in range(d):
                    if v[k]:
                        for i in range(k + 1, d):
                            v[i] -= steps[k][i] * v[k]
                for k in reversed(range(d)):
                    v[k] = (v[k] - sum((x * y for x, y in zip(m[k][k + 1 :], v[k + 1 :], strict=True)), Decimal(0))) / m[k][k]
                for _ in range(2):
                    for u in found:
                        part = sum(x * y for x, y in zip(u, v, strict=True))
                        v = [x - part * y for x, y in zip(v, u, strict=True)]
                    norm = sum(x * x for x in v).sqrt()
                    v = [x / norm for x in v]
            found.append(v)
        signed = [[x.copy_sign(x * max(v, key=abs)) for x in v] for v in found]  # the greatest entry is above zero
        return [[float(x) for x in v] for v in signed]


def components(spark: SparkSession, a: np.ndarray, most: int) -> tuple[np.ndarray, list[Fraction]]:
    """The unit eigenvectors of the greatest eigenvalues as columns, and these; zero ones come last."""
    d = len(a)
    roots, s = greatest_roots(characteristic_polynomial(spark, a), most)
    values = [Fraction(2 * m + 1, 2 << s) for m in roots]
    values += [Fraction(0)] * (min(most, d) - len(values))
    near = [k for k in range(1, len(values)) if values[k - 1] - values[k] > values[0] / (1 << ONE)]
    cuts = list(zip([0, *near], [*near, len(values)], strict=True))
    rows = a.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, root, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with decimal.localcontext(decimal.Context(prec=DIGITS)):
                    top, bottom = root.split("/")
                    root = Decimal(top) / Decimal(bottom)
                found = null_space(rows, root, n)
                yield pa.RecordBatch.from_arrays([pa.array([start] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(found)], ["k", "i", "v"])

    spaces = [(i, "{}/{}".format(*(sum(values[i:j]) / (j - i)).as_integer_ratio()), j - i) for i, j in cuts]
    todo = spark.createDataFrame(spaces, "k int, root string, n int").repartition(len(spaces))
    found = sorted((r.k + r.i, r.v) for r in todo.mapInArrow(work, "k int, i int, v array<double>").collect())
    return np.array([v for _, v in found]).T, values


def fit(vectors: DataFrame, vector: str = "embedding", most: int = MOST, factor: int = FACTOR) -> Whitening:
    """The whitening of all vectors that count."""
    n, sums, square = moments(vectors, vector, factor)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), [])
    s = np.array(sums, object)
    a = n * square - np.outer(s, s)
    vectors_of, values = components(vectors.sparkSession, a, most)
    trace = sum(int(a[i, i]) for i in range(len(a)))
    return Whitening(n, sums, vectors_of, np.array([float(e / n**2) for e in values]), [float(e / trace) if trace else None for e in values])


def projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows of integers, centred, on the components that are used, over the roots of their eigenvalues."""
    sums = np.array(model.sums, object)
    if largest(y) * model.n < IN_LONG and largest(sums) < IN_LONG:
        centred = (y.astype(np.int64) * model.n - sums.astype(np.int64)) / model.n
    else:
        centred = np.array([[float(Fraction(int(v) * model.n - t, model.n)) for v, t in zip(row, model.sums, strict=True)] for row in y.tolist()])
    return centred @ model.components[:, model.used] / np.sqrt(model.eigenvalues[model.used])


def deviations(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Exact squared distances of n times each row from the sums, as Python integers."""
    sums = np.array(model.sums, object)
    small = largest(y) * max(largest(y), sum(abs(s) for s in model.sums)) * max(1, y.shape[1]) < IN_LONG
    y = y.astype(np.int64 if small else object)
    norms, dots = (y * y).sum(1).astype(object), (y @ (sums.astype(np.int64) if small else sums)).astype(object)
    return model.n**2 * norms - 2 * model.n * dots + int((sums * sums).sum())


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding", factor: int = FACTOR) -> float | None:
    """The largest absolute entry of the covariance of whitened rows minus the identity.

    The rows are centred before they are multiplied; what their mean still differs
    from zero by rounding is taken off.
    """
    used = len(model.used)
    if not used:
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((used + 1, used))
        for b in batches:
            _, x = finite_vectors(b.column(0))
            if len(x):
                w = projected(floors(x, factor), model)
                total += np.vstack([w.sum(0), w.T @ w])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    found = vectors.select(F.col(f"`{vector}`").alias("v")).mapInArrow(work, "i int, j int, total double")
    sums = {(r.i, r.j): r.total / model.n for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return max(abs(sums[i, j] - sums[-1, i] * sums[-1, j] - (i == j)) for i in range(used) for j in range(used))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST, factor: int = FACTOR, fitted: Whitening | None = None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each vector and component up to ``most``.

    deviation is a decimal, as it grows with the square of n.  With ``fitted`` the
    whitening of other vectors is applied, and identity_error is that of these here.
    """
    model = fitted or fit(vectors, vector, most, factor)
    error = identity_error(vectors, model, vector, factor)
    k = len(model.eigenvalues)
    of = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = finite_vectors(b.column(1))
            if not len(rows) or not k:
                continue
            y = floors(x, factor)
            if y.shape[1] != len(model.sums):
                raise ValueError(f"vectors of different lengths: {sorted((y.shape[1], len(model.sums)))}")
            w = np.full((len(rows), k), np.nan)
            w[:, model.used] = projected(y, model)
            repeat = pa.array(np.repeat(np.arange(len(rows)), k))
            m = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(m, model.n), pa.int64()), decimals(deviations(y, model)).take(repeat), pa.array(w.ravel(), from_pandas=True),
                    pa.array(model.explained * len(rows), pa.float64()), pa.array([error] * m, pa.float64()),
                ],
                names,
            )

    types = [of.schema["key"].dataType, T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    return of.mapInArrow(work, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])).withColumnRenamed("key", key)
