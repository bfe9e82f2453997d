"""Operator 13 against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest

from parcelry.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, x string, v string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, tuple(x + [0] * (d - len(x)))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    return kept, n, sums, value[::-1], vector[:, ::-1], np.trace(cov)


def check(spark, rows, k=4):
    kept, n, sums, value, vector, trace = brute(rows)
    got = wh.op13_whitening(frame(spark, rows)).collect()
    assert len(got) == k * len(kept)
    assert all(r.n == n and r.identity_error < 1e-10 for r in got)
    want = {}
    for i, x in kept:
        top = [n * c - s for c, s in zip(x, sums)]
        want.setdefault(i, []).append((sum(t * t for t in top), (np.array(top, float) / n) @ vector[:, :k] / np.sqrt(value[:k])))
    sign = {}
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
        assert math.isclose(r.explained, value[r.component - 1] / trace, rel_tol=1e-9)
    for (i, component), found in by_id.items():
        pairs = sorted((d, abs(w[component - 1]), w[component - 1]) for d, w in want[i])
        for r, (dev, size, white) in zip(sorted(found, key=lambda r: (r.deviation, abs(r.whitened))), pairs):
            assert r.deviation == dev
            assert math.isclose(abs(r.whitened), size, rel_tol=1e-7, abs_tol=1e-8)
            if size > 1e-3:
                sign.setdefault(component, set()).add(np.sign(r.whitened) == np.sign(white))
    assert all(len(s) == 1 for s in sign.values()), "one sign a component"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(9, 9)) * np.array([5, 3, 2, 1.5, 1, 0.7, 0.5, 0.3, 0.2])[:, None]
    out = [(i, (rng.normal(size=9) @ mix + 7).tolist()) for i in range(400)]
    out += [(1000 + i, out[3][1]) for i in range(150)] + [(3, out[3][1]), (3, out[4][1]), (None, out[5][1]), (None, [0.0] * 9)]
    out += [(2000, None), (2001, [None] + [1.0] * 8), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (2004, []), (2005, [-0.0, 1.0])]
    return out


def test_against_numpy(spark, rows):
    check(spark, rows)


def test_large_offsets_and_dependent_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, size=(300, 5)) / 256
    v = np.hstack([base, base[:, :3], np.full((300, 2), 4.0)]) + 1e6
    check(spark, [(i, x.tolist()) for i, x in enumerate(v)])


def test_few_directions(spark):
    check(spark, [(i, [float(i % 7), 2.0 * (i % 7), 3.0]) for i in range(30)], k=1)
    assert wh.op13_whitening(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.op13_whitening(frame(spark, [(1, None), (2, [])])).collect() == []
    assert wh.op13_whitening(frame(spark, [])).collect() == []


def test_values_beyond_64_bits_are_errors(spark):
    with pytest.raises(Exception, match="64 bits"):
        wh.op13_whitening(frame(spark, [(1, [1e300]), (2, [0.0])])).collect()
    with pytest.raises(Exception, match="64 bits"):
        wh.op13_whitening(frame(spark, [(1, [1e10]), (2, [0.0]), (3, [5.0])])).collect()


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (5, 5), (8, 3), (33, 20), (3, 0)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        a = b @ b.T
        factor, order = wh.pivoted_cholesky(a)
        assert factor.shape == (d, rank)
        assert np.allclose(np.triu(factor, 1), 0)
        assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12 * max(1, np.abs(a).max()))
        value, vector = wh.eigen(a)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:rank]
        assert np.allclose(value, want, rtol=1e-9, atol=1e-12 * np.abs(a).max())
        assert np.allclose(vector.T @ vector, np.eye(rank), atol=1e-10)
