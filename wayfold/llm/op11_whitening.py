"""Embedding whitening from the exact characteristic polynomial of the scatter.

Entries become whole numbers, so the scatter matrix of the distinct vectors
(n times the centred sum of products) is exact. Its characteristic polynomial
is found modulo enough primes by Hessenberg reduction, primes dealt over
tasks, and put together by Chinese remainders; as the scatter is positive
semidefinite, the coefficients' signs are known and their sizes bounded. All roots are
real, so the sign changes of the polynomial shifted to a point count the roots
above it exactly, with multiplicity: bisection isolates the largest roots and then refines
them to ``BITS`` bits. Each root's components are null vectors of the shifted
scatter by inverse iteration in decimal arithmetic, roots dealt over tasks.

Defined cases: rows with a null vector, a null or non-finite entry or one beyond
2**56 (its whole number would not fit 64 bits) are dropped, and so are
vectors of another length than the most frequent one (ties: the longer); null
and repeated ids stay rows of their own; repeated vectors count once in the
fit; roots that are zero have no whitening and give no rows (one distinct
vector gives none at all); equal roots share any orthonormal components of their
space; empty tables and vectors without entries give no rows; other columns
are not read. ``deviation`` is null where it does not fit 64 bits;
``deviation_text`` always has it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**56
COMPONENTS = 16
#: Bits to which roots are refined, against the largest root; roots closer than that count as equal.
BITS = 256
#: Decimal digits of inverse iteration.
DIGITS = 200
_LIMB = 32


def whole(column: str) -> Column:
    """The vector's whole numbers; null for a vector that is dropped."""
    good = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    return F.when(F.col(column).isNotNull() & good, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole numbers less the shift, one row a vector."""
    flat = column.flatten()
    return np.asarray(flat, np.int64).reshape(-1, width) - SHIFT


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python integers."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    step = 1 << 13
    for low in range(0, len(y), step):
        part = y[low : low + step]
        if np.abs(part).max() < 1 << 20:
            f = part.astype(np.float64)
            out += (f.T @ f).astype(np.int64).astype(object)  # below 2**53, so exact
        else:
            o = part.astype(object)
            out += o.T.dot(o)
    return out


def _scatter_rows(width: int):
    """A task's number of vectors (row -2), sums (row -1) and sums of products, each in four limbs."""

    def run(batches):
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0), width)
                n += len(y)
                sums += y.astype(object).sum(axis=0)
                products += _products(y)
        upper = np.triu_indices(width)
        i = np.concatenate([[-2], np.full(width, -1), upper[0]])
        j = np.concatenate([[0], np.arange(width), upper[1]])
        value = [n, *sums, *products[upper]]
        limbs = [[v >> (_LIMB * k) if k == 3 else (v >> (_LIMB * k)) & 0xFFFFFFFF for v in value] for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["i", "j", "l0", "l1", "l2", "l3"])

    return run


@dataclass
class Scatter:
    """Of ``n`` distinct vectors: sums of the shifted whole numbers, and n times the centred sums of products."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(row[k] for k, row in enumerate(self.matrix))


def scatter(vectors: DataFrame, width: int) -> Scatter:
    """The exact scatter of the distinct vectors in column ``x``."""
    rows = vectors.select("x").distinct().mapInArrow(_scatter_rows(width), "i int, j int, l0 long, l1 long, l2 long, l3 long")
    total = rows.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(4))).collect()  # one row an entry
    value = {(r.i, r.j): sum(r[f"l{k}"] << (_LIMB * k) for k in range(4)) for r in total}
    n = value.get((-2, 0), 0)
    sums = [value.get((-1, k), 0) for k in range(width)]
    matrix = [[n * value.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    return Scatter(n, sums, matrix)


# The characteristic polynomial


def primes(count: int, span: int = 1 << 16) -> list[int]:
    """The largest primes below 2**31, falling."""
    small = np.ones(46_342, bool)
    small[:2] = False
    for k in range(2, 216):
        if small[k]:
            small[k * k :: k] = False
    out: list[int] = []
    top = 1 << 31
    while len(out) < count:
        block = np.ones(span, bool)
        low = top - span
        for p in np.flatnonzero(small):
            block[-low % p :: p] = False
        out += (np.flatnonzero(block)[::-1] + low).tolist()
        top = low
    return out[:count]


def modular_polynomial(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo a prime, constant first."""
    h = (np.array(matrix, object) % p).astype(np.int64)
    d = len(h)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1 :, c])
        if not len(below):
            continue
        at = c + 1 + below[0]
        if at != c + 1:
            h[[c + 1, at]] = h[[at, c + 1]]
            h[:, [c + 1, at]] = h[:, [at, c + 1]]
        u = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2 :] = (h[c + 2 :] - u[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        polys[m, 1:] = polys[m - 1, :-1]
        polys[m] = (polys[m] - h[m - 1, m - 1] * polys[m - 1] % p) % p
        chain = 1
        for i in range(1, m):
            chain = chain * int(h[m - i, m - i - 1]) % p
            if not chain:
                break
            polys[m] = (polys[m] - int(h[m - 1 - i, m - 1]) * chain % p * polys[m - 1 - i] % p) % p
    return polys[d].tolist()


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(xI - matrix) of a positive semidefinite matrix of whole numbers, constant first."""
    d = len(matrix)
    mean = -(-sum(matrix[k][k] for k in range(d)) // d)
    bound = (1 + mean) ** d  # above any elementary symmetric function of roots with that mean
    need = primes(bound.bit_length() // 30 + 2)
    tasks = min(len(need), 4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            p = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array([modular_polynomial(matrix, x) for x in p], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(x,) for x in need], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()  # bounded by the dimension
    modulus = math.prod(r.p for r in rows)
    share = [(modulus // r.p) * pow(modulus // r.p, -1, r.p) for r in rows]
    out = []
    for k in range(d + 1):
        sign = -1 if (d - k) % 2 else 1
        out.append(sign * (sum(s * (sign * r.c[k] % r.p) for s, r in zip(share, rows, strict=True)) % modulus))
    return out


# Roots


def above(poly: list[int], a: int, s: int) -> int:
    """How many roots exceed a / 2**s, if all roots are real: the sign changes after the shift."""
    while s and a % 2 == 0:
        a, s = a // 2, s - 1
    d = len(poly) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, s: int) -> int:
    while s and a % 2 == 0:
        a, s = a // 2, s - 1
    total, power = 0, 0
    for c in reversed(poly):
        total = total * a + (c << power)
        power += s
    return (total > 0) - (total < 0)


def roots(poly: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with their multiplicities, falling, until ``most`` are counted."""
    zero = next(k for k, c in enumerate(poly) if c)
    poly = poly[zero:]
    d = len(poly) - 1
    if not d:
        return []
    top = (-poly[d - 1]).bit_length()  # the sum of the roots bounds each
    s = max(0, BITS - top)
    low_limit = max(1, 1 << max(0, top + s - BITS))
    out: list[tuple[Fraction, int]] = []
    stack = [(0, 1 << (top + s), d, 0)]  # roots in (low, high], with the counts above either end
    while stack and sum(m for _, m in out) < most:
        low, high, n_low, n_high = stack.pop()
        inside = n_low - n_high
        if not inside:
            continue
        if inside == 1 or high - low <= low_limit:
            while inside == 1 and high - low > low_limit:
                middle = (low + high) // 2
                sign = _sign(poly, middle, s)
                if not sign:
                    low = high = middle
                elif sign == (-1) ** n_high:  # above the root
                    high = middle
                else:
                    low = middle
            out.append((Fraction(low + high, 2 << s), inside))
            continue
        middle = (low + high) // 2
        n = above(poly, middle, s)
        stack += [(low, middle, n_low, n), (middle, high, n, n_high)]
    return out


# Components


def null_vectors(matrix: list[list[int]], root: Fraction, many: int) -> list[list[Decimal]]:
    """Orthonormal vectors of a root's space: inverse iteration next to the root."""
    with localcontext() as ctx:
        ctx.prec = DIGITS
        d = len(matrix)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        near = Decimal(root.numerator) / Decimal(root.denominator)
        tiny = max(near, Decimal(1)) * Decimal(10) ** -(DIGITS * 2 // 5)
        for k in range(d):
            a[k, k] -= near + tiny  # beside the root, so no pivot need be zero
        order = np.arange(d)
        for c in range(d):
            at = c + int(np.argmax(np.abs(a[c:, c])))
            a[[c, at]], order[[c, at]] = a[[at, c]], order[[at, c]]
            if not a[c, c]:
                a[c, c] = tiny
            a[c + 1 :, c] = a[c + 1 :, c] / a[c, c]
            a[c + 1 :, c + 1 :] -= np.outer(a[c + 1 :, c], a[c, c + 1 :])
        found: list[np.ndarray] = []
        for start in range(many):
            v = np.array([Decimal(1 + (k * 7919 + start * 104729 + k * k * (start + 3)) % 1009) for k in range(d)], object)
            for _ in range(3):
                v = v[order]
                for k in range(1, d):
                    v[k] -= a[k, :k].dot(v[:k])
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1 :].dot(v[k + 1 :]) if k < d - 1 else 0)) / a[k, k]
                for u in found:
                    v = v - u * u.dot(v)
                v = v / v.dot(v).sqrt()
            found.append(v)
        return [list(v) for v in found]


@dataclass
class Whitening:
    scatter: Scatter
    roots: list[Fraction]
    components: np.ndarray
    identity_error: float

    def explained(self) -> list[float]:
        return [float(r / self.scatter.trace) for r in self.roots]


def fit(vectors: DataFrame, width: int, most: int = COMPONENTS) -> Whitening:
    """Whitening by the largest components of the distinct vectors in ``x``."""
    spark = vectors.sparkSession
    s = scatter(vectors, width)
    found = roots(polynomial(spark, s.matrix), most) if s.n else []
    jobs, left = [], most
    for k, (root, n) in enumerate(found):
        jobs.append((k, str(root), min(n, left)))
        left -= min(n, left)
    if not jobs:
        return Whitening(s, [], np.zeros((0, width)), 0.0)
    matrix = s.matrix

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            each = [[[str(x) for x in v] for v in null_vectors(matrix, Fraction(r["root"]), r["many"])] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.list_(pa.list_(pa.string())))], ["k", "v"])

    rows = spark.createDataFrame(jobs, "k int, root string, many int").repartition(len(jobs)).mapInArrow(run, "k int, v array<array<string>>").collect()
    each = [(found[r.k][0], v) for r in sorted(rows) for v in r.v]
    components = np.array([[float(x) for x in v] for _, v in each])
    return Whitening(s, [r for r, _ in each], components, _identity_error(s, [r for r, _ in each], components))


def _identity_error(s: Scatter, found: list[Fraction], components: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance less the identity; whitening is linear, so the scatter gives it."""
    with localcontext() as ctx:
        ctx.prec = 60
        c = np.array([[Decimal(float(x)) for x in v] for v in components], object)
        m = np.array([[Decimal(x) for x in row] for row in s.matrix], object)
        scale = np.array([(Decimal(r.numerator) / Decimal(r.denominator)).sqrt() for r in found], object)
        cov = c.dot(m).dot(c.T) / np.outer(scale, scale)
        return float(np.abs(cov - np.eye(len(found), dtype=int)).max())


def _apply(model: Whitening):
    """Whitened components of each vector, one row a component."""
    n, width, k = model.scatter.n, len(model.scatter.sums), len(model.roots)
    mean = np.array([float(Fraction(x, n)) for x in model.scatter.sums])
    turn = (model.components / np.array([[math.sqrt(r / n**2)] for r in model.roots])).T
    sums = np.array(model.scatter.sums, object)
    explained, error, most = model.explained(), model.identity_error, max(map(abs, model.scatter.sums), default=0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(1), width)
            white = (y - mean) @ turn
            if width * (n * int(np.abs(y).max()) + most) ** 2 < 1 << 62:
                off = n * y - sums.astype(np.int64)
                far = (off * off).sum(axis=1).tolist()
            else:
                off = n * y.astype(object) - sums
                far = (off * off).sum(axis=1).tolist()
            rows = np.repeat(np.arange(len(y)), k)
            fits = [x if x < 1 << 63 else None for x in far]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()),
                    pa.array(np.full(len(rows), n), pa.int64()),
                    pa.array(fits, pa.int64()).take(pa.array(rows)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(y))),
                    pa.array(np.full(len(rows), error)),
                    pa.array([str(x) for x in far]).take(pa.array(rows)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"],
            )

    return run


def whole_vectors(vectors: DataFrame, id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id`` and whole numbers ``x`` of the rows that remain, and their length."""
    rows = vectors.select(F.col(id).alias("vec_id"), whole(column).alias("x")).where("x is not null")
    sizes = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = sizes[0].width if sizes else 0
    return rows.where(F.size("x") == width), width


def whiten(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row a vector and component, with the vector's deviation from the mean."""
    rows, width = whole_vectors(vectors, id, column)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    model = fit(rows, width, most) if width else None
    if not model or not model.roots:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_apply(model), schema)
