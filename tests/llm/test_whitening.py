from __future__ import annotations

import numpy as np
import pytest

from pathlore.llm.whitening import eigenpairs, whiten


def rows_of(seed, n, dim, spread=None):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim)) @ np.diag(spread if spread is not None else np.linspace(3, 0.2, dim)) @ np.linalg.qr(r.normal(size=(dim, dim)))[0]
    return [(i, [float(v) for v in x]) for i, x in enumerate(base)]


def brute(rows, components):
    x = np.array([np.floor(np.array(v) * 64).astype(np.int64) + 1_000_000 for _, v in rows])
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    d = x - np.array([v / n for v in s])
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return d @ u / np.sqrt(e), e / np.trace(d.T @ d / n), deviation


@pytest.mark.parametrize("dim", [1, 5, 40, 64])
def test_brute_force(spark, dim):
    rows = rows_of(dim, 400, dim)
    bad = [(900, None), (901, []), (902, [None] + [0.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [1.0] * (dim + 1))]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, component int, x string").repartition(5)
    got = whiten(df).toPandas().sort_values(["vec_id", "component"])
    k = min(32, dim)
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.tolist() == np.repeat(np.arange(400), k).tolist() and got.component.tolist() == list(range(1, k + 1)) * 400
    white, explained, deviation = brute(rows, 32)
    w = got.whitened.to_numpy().reshape(400, k)
    sign = np.sign((w * white).sum(axis=0))
    assert np.abs(w * sign - white).max() < 1e-8
    assert got.explained.to_numpy()[:k] == pytest.approx(explained, rel=1e-10)
    assert got.deviation.tolist() == np.repeat(np.array(deviation, dtype=object), k).tolist()
    assert (got.n == 400).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_degenerate(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, None)])).count() == 0
    one = whiten(make([(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    flat = whiten(make([(i % 3, [float(i), 5.0, float(i)]) for i in range(10)] * 2)).toPandas()
    assert len(flat) == 60 and flat[flat.component > 1].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all()
    assert flat.identity_error.max() < 1e-10
    huge = whiten(make([(1, [1e30, 0.0]), (2, [3e12, 0.0]), (3, [-3e12, 1.0])])).toPandas()
    assert set(huge.vec_id) == {2, 3}
    assert huge.deviation.isna().all()  # (2 * 64 * 3 * 10^12)^2 is no long


@pytest.mark.parametrize("dim,count", [(300, 12), (120, 32), (7, 7), (50, 1)])
def test_eigenpairs_without_the_whole_space(dim, count):
    r = np.random.default_rng(dim)
    u = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    e = np.sort(r.exponential(size=dim))[::-1]
    e[3:5] = e[min(3, dim - 1)]  # a double eigenvalue
    a = u * np.sort(e)[::-1] @ u.T
    calls = []

    def apply(x):
        calls.append(x.shape[1])
        return a @ x

    values, vectors = eigenpairs(apply, dim, count)
    assert values == pytest.approx(np.sort(e)[::-1][:count], abs=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-11
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * e.max() * 10
    assert len(calls) < 400
