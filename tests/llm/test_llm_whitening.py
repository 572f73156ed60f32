"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from runlens.llm import bidiagonal as B
from runlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n string, whitened string, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", "n", "w", "k") for i, v in rows], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def longs(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def expected(rows, components=16):
    good = [(i, longs(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)] for x in fit])
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return good, n, s, e, v, np.trace(cov)


def vectors(n=300, d=20, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ (rng.normal(size=(d, d)) * np.logspace(0, -1.5, d))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(0, rows[0][1])] * 30
    return rows + [(2000, None), (2001, [math.nan] * d), (2002, [math.inf, *[0.0] * (d - 1)]), (2003, [None, *[1.0] * (d - 1)]), (2004, []), (2005, [1.0, 2.0]), (None, rows[3][1])]


def test_whitened_rows_match_numpy(spark):
    rows = vectors()
    usable = [(i, v) for i, v in rows if v is None or len(v) == 20]
    good, n, s, e, v, trace = expected(usable)
    got = rows_of(W.whiten(frame(spark, rows), "vec_id", "embedding"))
    assert len(got) == 16 * len(good)
    by = {}
    for i, c, rn, dev, w, ex, err in got:
        assert rn == n and err < 1e-9
        assert ex == pytest.approx(e[c - 1] / trace, rel=1e-10)
        by.setdefault(i, {}).setdefault(c, []).append((dev, w))
    sign = {}
    for i, x in good:
        z = np.array([float(Fraction(n * a - t, n)) for a, t in zip(x, s, strict=True)])
        for c in range(1, 17):
            for dev, w in by[i][c]:
                assert dev == sum((n * a - t) ** 2 for a, t in zip(x, s, strict=True))
                want = float(z @ v[:, c - 1]) / math.sqrt(e[c - 1])
                sg = sign.setdefault(c, 1.0 if w * want >= 0 else -1.0)
                assert w == pytest.approx(sg * want, abs=1e-8)


def test_rounds_of_merging_and_blocks_agree(spark, monkeypatch):
    rows = vectors(seed=11)
    whole = sorted(rows_of(W.whiten(frame(spark, rows), "vec_id", "embedding")), key=str)
    monkeypatch.setattr(W, "ROWS", 7)
    monkeypatch.setattr(W, "FAN", 2)
    small = sorted(rows_of(W.whiten(frame(spark, rows).repartition(13), "vec_id", "embedding")), key=str)
    assert [r[:4] for r in whole] == [r[:4] for r in small]
    assert np.allclose([abs(r[4]) for r in whole], [abs(r[4]) for r in small], atol=1e-9)


def test_rank_and_edges(spark):
    cols = "vec_id, component, n, deviation, whitened, explained, identity_error".split(", ")
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]  # one direction varies
    got = W.whiten(frame(spark, flat), "vec_id", "embedding")
    assert got.columns == cols and {r.component for r in got.collect()} == {1}
    assert all(r.explained == pytest.approx(1.0) and r.identity_error < 1e-12 for r in got.collect())
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        none = W.whiten(frame(spark, rows), "vec_id", "embedding")
        assert none.columns == cols and none.collect() == []
    # two lengths equally frequent: the smaller one; a deviation beyond a long is null
    two = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])]
    assert {r.vec_id for r in W.whiten(frame(spark, two), "vec_id", "embedding").collect()} == {1, 2}
    huge = [(i, [float(i) * 1e30, 1.0]) for i in range(4)]
    assert {r.deviation for r in W.whiten(frame(spark, huge), "vec_id", "embedding").collect()} == {None}


def spread(values, n=None, seed=0):
    rng = np.random.default_rng(seed)
    n = n or len(values)
    left, right = (np.linalg.qr(rng.normal(size=(m, m)))[0] for m in (n, len(values)))
    return left[:, :len(values)] * np.asarray(values, float) @ right


@pytest.mark.parametrize("a", [
    np.random.default_rng(1).normal(size=(90, 40)), spread(np.logspace(0, -7, 30)), spread(np.repeat([3.0, 2.0, 1.0], 12)),
    spread(1 + 1e-9 * np.arange(25)), np.eye(12), np.ones((9, 5)), np.zeros((4, 4)), spread([5.0, 4, 3], 20, 2), np.diag([2.0, 0.0, 1.0]),
    np.random.default_rng(2).normal(size=(3, 30)),
], ids=str)
def test_solver_matches_numpy(a):
    values, axes = B.principal(a)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    rank = int((want > 1e-24 * max(want[0], 1e-300)).sum()) if want[0] else 0
    assert len(values) == rank
    if rank:
        assert np.abs(values - want[:rank]).max() <= 1e-13 * want[0]
        assert np.abs(axes.T @ axes - np.eye(rank)).max() < 1e-10
        assert np.abs(a.T @ (a @ axes) - axes * values).max() <= 1e-12 * want[0]


def test_small_singular_values_keep_their_digits():
    """dqds on a graded bidiagonal against rational arithmetic's product of all values."""
    rng = random.Random(3)
    d = [rng.uniform(1, 2) * 10.0 ** -i for i in range(12)]
    e = [rng.uniform(0.1, 1) * 10.0 ** -i for i in range(11)]
    got = B.dqds(np.array(d), np.array(e))
    product = math.prod(Fraction(x) ** 2 for x in d)
    assert math.prod(Fraction(float(x)) for x in got) / product == pytest.approx(1, rel=1e-13)
    inverse = np.linalg.inv(np.diag(d) + np.diag(e, 1))
    assert got[-1] == pytest.approx(1 / np.linalg.norm(inverse, 2) ** 2, rel=1e-12)
