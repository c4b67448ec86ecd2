"""Exact top-k and whitening against brute force."""

import math

import numpy as np
import pytest

from runloom.llm import nearest, whiten

VECTORS = "vec_id long, embedding array<double>, score long, x string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(parts)


def whole(v):
    return [math.floor(64 * c) for c in v]


def brute_top(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = whole(v)
        if sum(c * c for c in x) >= nearest.LONGEST:
            continue
        best[i] = min(best.get(i, x), x)
    out = {}
    for i, q in best.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in best.items() if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def odd_vectors(rng):
    rows = [(i, (rng.normal(size=16) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, [0.0] * 16), (2020, [1.0] * 16), (2001, []), (2040, [])]
    rows += [(3000, None), (3020, [1.0, None] * 8), (3040, [float("nan")] * 16), (3060, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0] * 40), (4020, [-1.0] * 17)]
    rows += [(0, rows[0][1]), (20, [9.0] * 16)]  # repeated and differing rows of an id
    rows += [(5000, [3e7] * 16), (5001, [1e9] * 16), (5020, [-(2.0**24)] * 16), (-(2**63), [0.5] * 16), (2**63 - 1, [0.5] * 16)]
    return rows


@pytest.mark.parametrize(("k", "pivots", "block", "annulus"), [(20, 8, 4096, 256), (5, 3, 32, 4), (20, 1, 16, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, k, pivots, block, annulus):
    monkeypatch.setattr(nearest, "ANNULUS", annulus)
    rows = odd_vectors(np.random.default_rng(k))
    got = {}
    for r in nearest.top_k(frame(spark, rows), k, 20, pivots, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(rows, k, 20)


def test_top_k_of_few(spark):
    assert nearest.top_k(frame(spark, [], 1)).count() == 0
    assert nearest.top_k(frame(spark, [(20, [1.0])], 1)).count() == 0
    got = nearest.top_k(frame(spark, [(20, [1.0]), (1, [2.0])], 1)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 1, 64 * 128)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12)) * 400
    x = np.floor(centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 12)) * 20).astype(np.int64)
    pivots = nearest.fit_pivots(x.astype(float), 6)
    at, dist = nearest.nearest_pivot(x.astype(float), pivots)
    order = np.lexsort((dist, at))
    x, at, dist = x[order], at[order], dist[order]
    annuli = nearest.Annuli(pivots)
    table = nearest.pa.table({"pivot": at, "dist": dist, "id": np.arange(900), "x": nearest.pa.array(x.tolist(), nearest.pa.list_(nearest.pa.int64()))})
    annuli.add(table.combine_chunks())
    bound = annuli.bounds(list(x[::20]))
    score = x[::20] @ x.T
    first = np.cumsum([0, *map(len, annuli.ids)])
    best = np.sort(score, axis=1)[:, -20]
    seen = 0
    for a in range(len(annuli.ids)):
        assert (bound[:, a] >= score[:, first[a] : first[a + 1]].max(1)).all()
        seen += (bound[:, a] >= best).sum()
    assert seen < bound.size / 2


def spectra():
    rng = np.random.default_rng(3)
    wide = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield np.diag([5.0, 5.0, 5.0, 1.0, 0.0])
    yield np.ones((6, 6))
    yield np.zeros((4, 4))
    yield np.array([[2.5]])
    yield wide @ np.diag(np.r_[[3.0] * 10, 3 + 1e-13 * np.arange(10), 2.0 ** -np.arange(20)]) @ wide.T
    yield np.diag(np.full(63, 1.0), 1) + np.diag(np.full(63, 1.0), -1) + 4 * np.eye(64)
    y = rng.normal(size=(300, 64))
    yield y.T @ y / 300


@pytest.mark.parametrize("v", list(spectra()))
def test_leading_components_equal_a_dense_solver(v):
    v = (v + v.T) / 2
    values, axes = whiten.leading_components(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    want = want[want > 1e-12 * max(want[0], 1e-300)]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * max(1, abs(v).max()) * len(v))
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ axes, axes * values, atol=1e-12 * max(1, np.abs(v).max()) * len(v))


def test_sturm_counts_and_reflections():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(30, 30))
    v = v + v.T
    diagonal, off, _ = whiten.tridiagonal(v)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    values = np.linalg.eigvalsh(v)
    assert np.allclose(np.linalg.eigvalsh(t), values)
    at = np.array([-100.0, 0.0, 1.5, 100.0])
    assert whiten.below(diagonal, off, at).tolist() == [(values < a).sum() for a in at]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=40) @ np.diag(np.linspace(0.2, 3, 40))).tolist()) for i in range(400)]
    rows += [(5, rows[5][1]), (None, rows[6][1])]  # repeated rows, a null id
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] * 40), (904, [1.0] * 3), (905, [1e300] * 40)]
    got = whiten.whitened(frame(spark, rows + odd)).toPandas()
    x = np.array([whole(v) for _, v in rows], dtype=np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 32 * n and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    deviation = ((n * x - sums) ** 2).sum(1)
    for j in (1, 2, 32):
        part = got[got.component == j]
        assert np.allclose(part.explained, values[j - 1] / values.sum(), rtol=1e-10)
        ids = {i: at for at, (i, _) in enumerate(rows) if at < 400}
        at = [ids[i] for i in part.vec_id.dropna().astype(int)]
        assert part.deviation[part.vec_id.notna()].tolist() == deviation[at].tolist()
        z = y[at] @ axes[:, j - 1] / np.sqrt(values[j - 1])
        mine = part.whitened[part.vec_id.notna()].to_numpy()
        assert min(np.abs(mine - z).max(), np.abs(mine + z).max()) < 1e-9


def test_whitening_of_little(spark):
    assert whiten.whitened(frame(spark, [], 1)).count() == 0
    assert whiten.whitened(frame(spark, [(1, [1.0, 2.0])] * 3, 1)).count() == 0  # no variance
    got = whiten.whitened(frame(spark, [(i, [float(i), 0.0, 2.0 * i]) for i in range(5)], 2)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviations_beyond_doubles():
    centre = whiten.Centre(3, [10**15 + 1, 5])
    x = np.array([[10**15, 2], [1, 1], [0, 2]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, (10**15 + 1, 5))) for row in x.tolist()]
    assert centre.deviations(x) == [w if w < 1 << 63 else None for w in want]
