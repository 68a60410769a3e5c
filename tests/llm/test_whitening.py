"""Whitening against plain arithmetic with fractions and a dense solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from daybook.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x int, label string"


def usable(v):
    return v and all(c is not None and math.isfinite(c) for c in v)


def plain(rows):
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if usable(v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = [[float(x[j] - Fraction(sums[j], n)) for j in range(len(sums))] for x in fit]
    values, vectors = np.linalg.eigh(np.array(exact).T @ np.array(exact) / n)
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        centred = np.array([float(a - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        out[i] = deviation, centred @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
    return n, out, values[::-1] / values.sum()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(parts)


def vectors(seed=1, n=300, d=20):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    return [[float(np.float32(c)) for c in v] for v in r.normal(size=(n, d)) @ mix + 3]


def held(spark, rows, components=16):
    n, want, share = plain(rows)
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == len(want) * components
    signs = {}
    for x in got:
        deviation, w = want[x.vec_id]
        assert (x.n, x.deviation) == (n, deviation)
        assert x.explained == pytest.approx(share[x.component - 1], rel=1e-9)
        assert abs(x.whitened) == pytest.approx(abs(w[x.component - 1]), rel=1e-8, abs=1e-8)
        if abs(x.whitened) > 1e-6:
            assert signs.setdefault(x.component, np.sign(x.whitened * w[x.component - 1])) == np.sign(x.whitened * w[x.component - 1])
        assert x.identity_error < 1e-9
    assert {x.component for x in got} == set(range(1, components + 1))


def test_equal_to_plain(spark):
    rows = list(enumerate(vectors()))
    rows += [(1000 + i, rows[i % 5][1]) for i in range(200)]  # copies count once
    rows += [(2000, None), (2001, [None] * 20), (2002, [1.0] * 19 + [float("nan")]), (2003, [float("-inf")] + [0.0] * 19), (2004, []), (2005, [1.0, 2.0])]
    held(spark, [r for r in rows if r[0] != 2005])
    got = W.whiten(frame(spark, rows))
    assert got.where("vec_id >= 2000").count() == 0 and got.count() == 500 * 16


def test_far_from_the_origin(spark):
    held(spark, [(i, [float(np.float32(c + 5000)) for c in v]) for i, v in enumerate(vectors(4, 80, 17))])


def test_components_without_variance(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), 7.0, float(a + b)]) for i, (a, b) in enumerate(r.integers(-9, 9, (60, 2)))]
    got = W.whiten(frame(spark, rows)).collect()
    assert {x.component for x in got} == {1, 2} and all(x.identity_error < 1e-9 for x in got)
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_empty_tables(spark):
    assert W.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whiten(frame(spark, [])).count() == 0 and W.whiten(frame(spark, [(1, None)])).count() == 0


def test_large_deviations_are_exact():
    x = np.array([[10**9, -(10**9)], [5, 7], [0, 0]], np.int64)
    m = W.Moments.of(x)
    model = W.Whitening.of(m, 2)
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, m.sums, strict=True)) for row in x]
    assert model.deviations(x) == [w if w < 2**63 else None for w in want]


def test_merging_in_any_order():
    r = np.random.default_rng(5)
    x = r.integers(10**6, 10**6 + 99, (500, 6))
    whole = W.Moments.of(x)
    parts = [W.Moments.of(p) for p in np.split(x, [3, 50, 51, 400])]
    for order in (parts, parts[::-1], [parts[0].merge(parts[3]), parts[4].merge(parts[1]), parts[2]]):
        m = order[0]
        for p in order[1:]:
            m = m.merge(p)
        assert m.n == 500 and m.sums == whole.sums
        assert np.allclose(m.scatter, whole.scatter, rtol=1e-12, atol=1e-8) and np.allclose(m.mean, whole.mean, rtol=1e-15)
