"""Whitening: the exact polynomial, its roots and components, held against floating point and small fixtures."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import op11_whitening as op
from wayfold.llm import queries


def psd(rng, d, rank=None):
    x = rng.integers(-50, 50, (rank or 3 * d, d))
    return (x.T @ x).tolist()


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(3)
    for d, rank in ((1, None), (2, None), (5, None), (8, 3), (12, None)):
        m = psd(rng, d, rank)
        poly = op.polynomial(spark, m)
        want = [int(x) for x in _charpoly(m)]
        assert poly == want
        found = op.roots(poly, d)
        eigen = sorted(np.linalg.eigvalsh(np.array(m, float)), reverse=True)
        flat = [float(r) for r, n in found for _ in range(n)]
        assert len(flat) == min(d, rank or d)
        assert np.allclose(flat, eigen[: len(flat)], rtol=1e-9)


def _charpoly(m):
    """Faddeev-LeVerrier in whole numbers, constant first."""
    d = len(m)
    a = np.array(m, object)
    eye = np.eye(d, dtype=int).astype(object)
    c, b = [1], eye
    for k in range(1, d + 1):
        ab = a.dot(b)
        c.append(-sum(ab[i, i] for i in range(d)) // k)
        b = ab + c[-1] * eye
    return c[::-1]


def test_equal_and_zero_roots():
    # (x - 7)**2 (x - 2) x
    poly = [0, -98, 77, -16, 1]
    found = op.roots(poly, 3)
    assert [(round(float(r), 30), n) for r, n in found] == [(7.0, 2), (2.0, 1)]
    v = op.null_vectors([[7, 0, 0], [0, 7, 0], [0, 0, 2]], Fraction(7), 2)
    gram = [[float(sum(a * b for a, b in zip(x, y, strict=True))) for y in v] for x in v]
    assert np.allclose(gram, np.eye(2)) and all(abs(float(x[2])) < 1e-30 for x in v)


def test_close_roots():
    """Roots that differ in the 30th digit are told apart."""
    a, b = 10**30, 10**30 + 1
    found = op.roots([a * b, -(a + b), 1], 2)
    assert [(int(r + Fraction(1, 2)), n) for r, n in found] == [(b, 1), (a, 1)]


def slow(rows, most=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), float)
    n = len(distinct)
    mean = distinct.mean(0)
    cov = (distinct - mean).T @ (distinct - mean) / n
    e, c = np.linalg.eigh(cov)
    order = np.argsort(-e)[:most]
    return kept, n, distinct.sum(0), mean, e[order], c[:, order], np.trace(cov)


def test_whitening_equals_floating_point(spark):
    rng = np.random.default_rng(5)
    scale = np.array([5.0, 3.0, 2.0, 1.0, 0.5])
    rows = [(int(k), [float(x) for x in rng.normal(size=5) * scale]) for k in range(200)]
    rows += rows[:50]  # repeated rows count once in the fit
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(0)})
    got = op.whiten(df, most=4).collect()
    kept, n, total, mean, e, c, trace = slow([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 4)
    assert len(got) == 4 * len(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for i, x in kept:
        far = sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))
        for k in range(4):
            r = by[i, k + 1][0]
            assert (r.n, r.deviation, r.deviation_text) == (n, far, str(far))
            want = (np.array(x) - mean) @ c[:, k] / math.sqrt(e[k])
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            assert abs(r.explained - e[k] / trace) < 1e-9 and r.identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [3.0, -1.0]), (6, [3.0, -1.0]), (None, [0.5, 0.25]), (7, [1.0]), (8, []), (9, [1e30, 1.0])]
    got = op.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (6, 1), (6, 1), (6, 2), (6, 2)] and {r.n for r in got} == {3}
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert op.whiten(one).count() == 0  # nothing varies
    for none in ("vec_id long, embedding array<double>", "vec_id string, embedding array<float>"):
        assert op.whiten(spark.createDataFrame([], none)).count() == 0
    assert op.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0


def test_wide_numbers_stay_exact(spark):
    big = 2.0**50
    rows = [(1, [big, 1.0]), (2, [-big, 3.0]), (3, [0.0, 8.0])]
    got = {r.vec_id: r for r in op.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=1).collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    total = [sum(v[k] for v in x.values()) for k in range(2)]
    for i, v in x.items():
        far = sum((3 * a - s) ** 2 for a, s in zip(v, total, strict=True))
        assert got[i].deviation_text == str(far) and got[i].deviation == (far if far < 1 << 63 else None)


def test_the_query(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).collect()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    kept, n, total, mean, e, c, trace = slow([(r.vec_id, r.embedding) for r in vectors])
    assert len(rows) == 16 * len(kept) and {r.n for r in rows} == {n}
    x = dict(kept)
    white = np.zeros((len(kept), 16))
    place = {i: k for k, i in enumerate(x)}
    for r in rows:
        white[place[r.vec_id], r.component - 1] = r.whitened
    want = (np.array(list(x.values()), float) - mean) @ c / np.sqrt(e)
    assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-6
    assert np.abs(white.T @ white / n - np.eye(16)).max() < 1e-8
