import math
import random

import numpy as np
from pyspark.sql import functions as F
from text_helpers import CLASHES

from duskwatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    """The fit by Python integers: n, sums, covariance numerators."""
    fit = sorted({tuple(v) for v in vectors})
    n, size = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(size)]
    cov = [[n * sum(v[d] * v[e] for v in fit) - sums[d] * sums[e] for e in range(size)] for d in range(size)]
    return fit, n, sums, cov


def test_cross_products_are_exact():
    rng = random.Random(5)
    for low, high, rows, size in ((0, 0, 3, 2), (-40, 40, 200, 5), (-(2**60), 2**60, 70, 3), (10**6, 10**6 + 3, 65, 4), (-(2**33), 5, 130, 2)):
        u = np.array([[rng.randint(low, high) for _ in range(size)] for _ in range(rows)], np.int64)
        want = [[sum(int(r[d]) * int(r[e]) for r in u) for e in range(size)] for d in range(size)]
        assert whitening.cross_products(u).tolist() == want


def test_whitening_against_integers(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.4
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # copies count once in the fit
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in [*CLASHES, "id", "x"]})
    own = whitening.quantized(frame)
    got = whitening.whiten(own, whitening.fit(own, components=4)).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted((r.id for r in got), key=str) == sorted((i for i, _ in kept), key=str)
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in kept}
    fit, n, sums, cov = plain(x.values())
    values = np.linalg.eigvalsh(np.array(cov, float) / n**2)[::-1]
    for r in got:
        assert r.n == n and int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x[r.id], sums)) and r.identity_error < 1e-9
        assert np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9)
    # Each column of the results is the projection on an eigenvector, over the root of its value.
    first = {tuple(x[r.id]): r.whitened for r in got}
    white = np.array([first[v] for v in fit])
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    axes = np.linalg.lstsq(centred, white, rcond=None)[0] * np.sqrt(values[:4])
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-9) and np.allclose(np.array(cov, float) / n**2 @ axes, axes * values[:4], atol=1e-6)
    assert np.allclose(white.T @ white / n, np.eye(4), atol=1e-9)


def test_whitening_edges(spark):
    rows = [(1, []), (2, [1.0]), (3, [1.0]), (4, [1e38, 0.0]), (5, [-1e38, 0.0]), (6, [1.0, 0.0]), (7, [1.0] * 3), (8, [2.0] * 3), (9, [2.0] * 3)]
    own = whitening.quantized(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in whitening.whiten(own, whitening.fit(own)).collect()}
    assert set(got) == set(range(1, 10)) and got[1].whitened == []
    assert got[2].whitened == [0.0] and got[2].n == 1 and got[2].deviation == 0 and got[2].explained == [0.0]
    assert got[4].n == 3 and abs(abs(got[4].whitened[0]) - math.sqrt(1.5)) < 1e-9 and got[4].whitened[1] == 0.0 and int(got[4].deviation) > 1 << 63
    assert got[7].n == 2 and got[8].whitened == got[9].whitened and abs(abs(got[7].whitened[0]) - 1) < 1e-9 and got[7].whitened[1:] == [0.0, 0.0]
    assert got[8].identity_error < 1e-9 and abs(got[8].explained[0] - 1) < 1e-12
    none = own.limit(0)
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
