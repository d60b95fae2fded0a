"""Whitening of embeddings with components from the exact characteristic polynomial.

1. Entries become integers; Spark counts each distinct vector once and adds up, exactly, the sums S
   and the products. The integer scatter M = n * sum(x x') - S S' is n * n times the covariance.
2. The characteristic polynomial of M modulo many 31-bit primes: each by similarity to Hessenberg
   form and its recurrence, primes dealt to Spark tasks. The coefficients follow by Chinese
   remaindering: up to sign they are the elementary symmetric sums of eigenvalues that are not
   negative, so they lie between 0 and C(d, k) * (trace / d)^k (Maclaurin), which says how many
   primes it takes.
3. All roots are real, so by Descartes' rule the sign changes of p(x + a) *are* the number of roots
   above a. Bisection on that count isolates each root with its multiplicity; signs of p, and then the
   count again where a root repeats, refine it to ``BITS`` bits. All of it is exact integer arithmetic.
4. A component is the null space of M - e, by inverse iteration from elimination with full pivoting, in
   fixed point of more than 2 * ``BITS`` bits; one task a root. A root that repeats has as many
   orthonormal components.

Only d x d numbers and d + 1 coefficients reach the driver; rows stay in tasks.

Cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; other rows keep a
null or repeated id; shorter vectors are filled up with zeros; roots that are zero have no component
(nothing can be divided by their square root), so an empty table, one vector, or copies of one vector
give no rows; an entry beyond 2**53 / 64 raises an error. Components have their largest entry above
zero.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinscope.llm.store import saved

COMPONENTS = 16
BITS = 160           # of a root, below its leading bit
SCALE = 64
OFFSET = 1_000_000   # of x; it moves S, and neither M nor a deviation
PRIMES = 32          # in a batch


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, y): floor(64 * c) of each entry, x being y + 1,000,000."""
    c = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    large = F.exists("embedding", lambda e: F.abs(e.cast("double")) * SCALE >= F.lit(float(1 << 53)))
    return (
        embeddings.where(F.col("embedding").isNotNull()).where(fine)
        .select("vec_id", F.when(large, F.raise_error(F.lit("an entry is beyond 2**53 / 64"))).otherwise(c).alias("y"))
    )


def filled(vectors: DataFrame, width: int) -> DataFrame:
    """Shorter vectors with zeros behind, so that equal ones are equal rows."""
    rest = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("y"))
    return vectors.withColumn("y", F.when(F.size("y") < width, F.concat("y", rest)).otherwise(F.col("y")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    size = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.list_flatten(column), np.int64)
    return out


def _products(width: int, batches):
    """(cell, total): cell -1 is the count, 0 to width - 1 the sums, the rest the products, row by row."""
    n, sums, squares = 0, np.zeros(width, object), np.zeros((width, width), object)
    for batch in batches:
        y = _matrix(batch.column("y"), width)
        n += len(y)
        peak = int(np.abs(y).max(initial=0))
        if peak * peak * len(y) < 1 << 53:      # exact in doubles
            f = y.astype(float)
            sums, squares = sums + y.sum(0).astype(object), squares + (f.T @ f).astype(np.int64).astype(object)
        else:
            o = y.astype(object)
            sums, squares = sums + o.sum(0), squares + o.T.dot(o)
    total = [n, *sums.tolist(), *squares.ravel().tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["cell", "total"])


def scatter(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums and M, over each distinct vector once; width * (width + 1) totals reach the driver."""
    distinct = vectors.select("y").distinct()
    cells = distinct.mapInArrow(partial(_products, width), "cell long, total decimal(38,0)").groupBy("cell").agg(F.sum("total").alias("total"))
    table = cells.orderBy("cell").toArrow()
    total = [int(t) for t in table.column("total").to_pylist()]
    if not total:
        return 0, np.zeros(width, object), np.zeros((width, width), object)
    n, sums = total[0], np.array(total[1: width + 1], object)
    return n, sums, n * np.array(total[width + 1:], object).reshape(width, width) - np.outer(sums, sums)


def _powmod(base: np.ndarray, prime: np.ndarray) -> np.ndarray:
    """Inverses modulo each prime, by Fermat."""
    out, base, left = np.ones_like(base), base.copy(), prime - 2
    while left.any():
        out = np.where(left & 1, out * base % prime, out)
        base, left = base * base % prime, left >> 1
    return out


def hessenberg_polynomials(m: np.ndarray, prime: np.ndarray) -> np.ndarray:
    """Coefficients, lowest first, of det(x - m[k]) modulo prime[k]; ``m`` is (primes, d, d), reduced."""
    h, d = m.astype(np.int64), m.shape[1]
    p, all_ = prime.astype(np.int64), np.arange(len(prime))
    p1, p2 = p[:, None], p[:, None, None]
    for j in range(d - 2):
        # Bring a pivot below the diagonal: the same swap of rows and of columns keeps similarity.
        at = j + 1 + np.argmax(h[:, j + 1:, j] != 0, axis=1)
        for side in (0, 1):
            a, b = (h[all_, j + 1].copy(), h[all_, at].copy()) if side == 0 else (h[all_, :, j + 1].copy(), h[all_, :, at].copy())
            if side == 0:
                h[all_, j + 1], h[all_, at] = b, a
            else:
                h[all_, :, j + 1], h[all_, :, at] = b, a
        factor = h[:, j + 2:, j] * _powmod(h[:, j + 1, j], p)[:, None] % p1      # 0 where there is no pivot
        h[:, j + 2:] = (h[:, j + 2:] - factor[:, :, None] * h[:, None, j + 1] % p2) % p2
        for r in range(factor.shape[1]):
            h[:, :, j + 1] = (h[:, :, j + 1] + factor[:, r, None] * h[:, :, j + 2 + r]) % p1
    polynomial = [np.zeros((len(p), d + 1), np.int64)]
    polynomial[0][:, 0] = 1
    for k in range(1, d + 1):
        before = polynomial[k - 1]
        now = np.zeros_like(before)
        now[:, 1:] = before[:, :-1]
        now = (now - h[:, k - 1, k - 1, None] * before) % p1
        below = np.ones(len(p), np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            now = (now - (h[:, k - i - 1, k - 1] * below % p)[:, None] * polynomial[k - i - 1]) % p1
        polynomial.append(now)
    return polynomial[d]


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than ``bits`` bits."""
    sieve_to = 46342
    small = np.ones(sieve_to, bool)
    small[:2] = False
    for k in range(2, 216):
        if small[k]:
            small[k * k:: k] = False
    small = np.flatnonzero(small)
    out, have, top = [], 0, 1 << 31
    while have <= bits:
        low = top - (1 << 16)
        span = np.ones(top - low, bool)
        for q in small.tolist():
            span[-low % q:: q] = False
        for q in (np.flatnonzero(span)[::-1] + low).tolist():
            out.append(q)
            have += q.bit_length() - 1
            if have > bits:
                break
        top = low
    return out


def _modular(shared, batches):
    """(prime, coefficients) of the primes of each batch."""
    entries, d = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, PRIMES):
            prime = batch.column("prime").slice(at, PRIMES).to_numpy()
            m = np.array([[e % q for e in entries] for q in prime.tolist()], np.int64).reshape(len(prime), d, d)
            yield pa.RecordBatch.from_pydict({"prime": pa.array(prime), "c": pa.array(hessenberg_polynomials(m, prime).tolist(), pa.list_(pa.int64()))})


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(x - M) for a positive semi-definite integer M."""
    d, trace = len(m), int(np.trace(m))
    bound = max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    chosen = primes(bound.bit_length() + 1)
    shared = spark.sparkContext.broadcast(([int(e) for e in m.ravel()], d))
    tasks = -(-len(chosen) // PRIMES)
    table = spark.createDataFrame([(q,) for q in chosen], "prime long").repartition(tasks)
    rows = table.mapInArrow(partial(_modular, shared), "prime long, c array<long>").collect()   # some 4 * d primes, d + 1 numbers each
    rows = {r["prime"]: r["c"] for r in rows}
    whole = 1
    for q in chosen:
        whole *= q
    out = [0] * (d + 1)
    for q in chosen:
        part = whole // q
        part *= pow(part, -1, q)
        for k in range(d + 1):
            out[k] += rows[q][k] * part
    # Signs alternate; each magnitude lies between 0 and the bound.
    return [(1 if (d - k) % 2 == 0 else -1) * ((out[k] if (d - k) % 2 == 0 else -out[k]) % whole) for k in range(d + 1)]


def _above(p: list[int], a: int, shift: int) -> int:
    """How many roots, with multiplicity, lie above a / 2**shift: sign changes of p(x + a / 2**shift)."""
    d = len(p) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(p)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(p: list[int], a: int, shift: int) -> int:
    """p(a / 2**shift), times a power of two."""
    out = 0
    for k, v in enumerate(reversed(p)):
        out = out * a + (v << (shift * k))
    return out


def largest_roots(p: list[int], count: int) -> list[tuple[int, int, int]]:
    """(a, shift, multiplicity): the largest positive roots a / 2**shift of a polynomial with real roots only.

    Roots come in falling order until ``count`` of them, with multiplicity, are there. Each is the
    lower end of an interval that holds it, 2**-BITS of its size or less.
    """
    zeros = next(k for k, v in enumerate(p) if v)
    p = p[zeros:]
    count = min(count, len(p) - 1)
    todo = [(0, 1 << max(1, (-p[-2]).bit_length()) if len(p) > 1 else 1, 0, 0, len(p) - 1)]   # low, high, shift, roots above high, above low
    out = []
    while todo and sum(m for *_, m in out) < count:
        low, high, shift, over, under = todo.pop()
        if low and (high - low) << BITS <= low:
            out.append((low, shift, under - over))
            continue
        if under - over == 1:
            # One root in (low, high]: the sign of p at the middle says on which side.
            sign = _value(p, high, shift) > 0 if _value(p, high, shift) else None
            while sign is not None and not (low and (high - low) << BITS <= low):
                if high - low == 1:
                    low, high, shift = 2 * low, 2 * high, shift + 1
                middle = (low + high) // 2
                v = _value(p, middle, shift)
                if v == 0:
                    low = high = middle
                elif (v > 0) == sign:
                    high = middle
                else:
                    low = middle
            out.append((high if sign is None else low, shift, 1))
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        held = _above(p, middle, shift)
        if under > held:
            todo.append((low, middle, shift, held, under))
        if held > over:
            todo.append((middle, high, shift, over, held))
    return out


def null_space(m: np.ndarray, a: int, shift: int, dimension: int) -> np.ndarray:
    """Orthonormal vectors, as columns, of the null space of m - a / 2**shift, by inverse iteration.

    Elimination with full pivoting leaves ``dimension`` pivots that are 0 but for rounding; they stand
    as the least unit. A first step starts from what elimination turns into a unit of one of them, a
    second one from the first's result.
    """
    d, rank = len(m), len(m) - dimension
    point = 2 * BITS + max(abs(int(e)) for e in m.ravel()).bit_length()   # bits behind the point
    one = 1 << point
    w = m.astype(object) * one
    w[np.arange(d), np.arange(d)] -= (a << point) >> shift
    rows, columns = np.arange(d), np.arange(d)
    lower = np.zeros((d, d), object)
    for k in range(rank):
        at = int(np.argmax(np.abs(w[k:, k:]).ravel()))
        r, c = k + at // (d - k), k + at % (d - k)
        for x in (w, lower, rows):
            x[[k, r]] = x[[r, k]]
        w[:, [k, c]] = w[:, [c, k]]
        columns[[k, c]] = columns[[c, k]]
        pivot = int(w[k, k])
        if pivot == 0:
            raise ArithmeticError("the null space is larger than the root's multiplicity")
        for i in range(k + 1, d):
            f = int(w[i, k])
            if f:
                lower[i, k] = (f << point) // pivot
                w[i, k:] = w[i, k:] - (f * w[k, k:]) // pivot
    upper, factor = [[int(x) for x in r] for r in w], [[int(x) for x in r] for r in lower]

    def back(b: list[int]) -> list[int]:
        v = [0] * d
        for k in range(d - 1, -1, -1):
            v[k] = b[k] << point if k >= rank else ((b[k] << point) - sum(upper[k][c] * v[c] for c in range(k + 1, d))) // upper[k][k]
        out = [0] * d
        for k, c in enumerate(columns.tolist()):
            out[c] = v[k]
        return _unit(out, point)

    def forward(v: list[int]) -> list[int]:
        b = [v[r] for r in rows.tolist()]
        for i in range(d):
            b[i] -= sum(factor[i][k] * b[k] for k in range(min(i, rank))) >> point
        return b

    basis = []
    for free in range(dimension):
        v = back(forward(back([int(k == rank + free) for k in range(d)])))
        for b in basis:                    # orthogonal to those before
            dot = sum(x * y for x, y in zip(v, b)) >> point
            v = _unit([x - ((dot * y) >> point) for x, y in zip(v, b)], point)
        basis.append(v)
    return np.array([[(x if max(b, key=abs) > 0 else -x) / one for x in b] for b in basis]).T


def _unit(v: list[int], point: int) -> list[int]:
    norm = isqrt(sum(x * x for x in v))
    return [(x << point) // norm for x in v]


def _components(shared, batches):
    """(number, v): the components of each root of the batch, numbered from its own first."""
    entries, d = shared.value
    m = np.array(entries, object).reshape(d, d)
    for batch in batches:
        for r in batch.to_pylist():
            v = null_space(m, int(r["a"]), r["shift"], r["times"])
            for k in range(v.shape[1]):
                yield pa.RecordBatch.from_pydict({"number": pa.array([r["first"] + k], pa.int32()), "v": pa.array([v[:, k].tolist()], pa.list_(pa.float64()))})


class Whitening:
    """n, sums, eigenvalues of the covariance, components as columns, and the error of the identity."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        spark = vectors.sparkSession
        self.width = vectors.agg(F.max(F.size("y"))).first()[0] or 0
        self.n, self.sums, m = scatter(filled(vectors, self.width), self.width)
        trace = int(np.trace(m)) if self.width else 0
        self.values, self.components, self.explained, self.identity_error = np.zeros(0), np.zeros((self.width, 0)), np.zeros(0), 0.0
        if not trace:
            return
        self.polynomial = characteristic(spark, m)
        roots = largest_roots(self.polynomial, components)
        shared = spark.sparkContext.broadcast(([int(e) for e in m.ravel()], self.width))
        first = np.cumsum([1, *(t for *_, t in roots)])
        asked = spark.createDataFrame([(str(a), s, t, int(f)) for (a, s, t), f in zip(roots, first)], "a string, shift int, times int, first int")
        rows = asked.repartition(len(roots), "first").mapInArrow(partial(_components, shared), "number int, v array<double>").collect()   # d numbers each
        rows = sorted(rows, key=lambda r: r["number"])[:components]
        self.components = np.array([r["v"] for r in rows]).T
        root = [x for a, s, t in roots for x in [(a, s)] * t][:components]
        self.values = np.array([a / (self.n * self.n << s) for a, s in root])
        self.explained = np.array([a / (trace << s) for a, s in root])
        # The covariance of the whitened fit list, from exact entries of M.
        scaled = self.components / np.sqrt(self.values)
        covariance = m.astype(float) / float(self.n) ** 2
        self.identity_error = float(np.abs(scaled.T @ covariance @ scaled - np.eye(len(root))).max())


def _deviation(y: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over entries of (n * y - S) ** 2, exact."""
    peak = n * int(np.abs(y).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if peak * peak * max(y.shape[1], 1) < 1 << 63:
        c = n * y - sums.astype(np.int64)
        return pa.array((c * c).sum(1)).cast(pa.decimal128(38, 0))
    c = n * y.astype(object) - sums
    return pa.array([Decimal(int(v)) for v in (c * c).sum(1)], pa.decimal128(38, 0))


def _project(shared, batches):
    n, sums, values, components, explained, error = shared.value
    width, count = components.shape
    mean = np.array([int(s) / n for s in sums])
    scaled = components / np.sqrt(values)
    for batch in batches:
        y = _matrix(batch.column("y"), width)
        white = (y - mean) @ scaled
        row = pa.array(np.repeat(np.arange(len(y)), count))
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))), pa.array(np.full(len(row), n, np.int64)),
            _deviation(y, n, sums).take(row), pa.array(white.ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(row), error))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that stays.

    ``deviation`` is a decimal, since it grows with the square of n.
    """
    vectors = saved(integers(embeddings), "integer-vectors")
    w = Whitening(vectors, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not len(w.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    shared = embeddings.sparkSession.sparkContext.broadcast((w.n, w.sums, w.values, w.components, w.explained, w.identity_error))
    return vectors.mapInArrow(partial(_project, shared), schema)
