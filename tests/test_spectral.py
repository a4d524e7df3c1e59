from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.operators import spectral as X
from pathlore.operators.stats import bartlett_kmo, corr_matrix
from pathlore.plans.tables import features, vectors

SMALL = np.array([[6, 8, 3, 5, 7], [3, 5, 9, 1, 2], [4, 4, 6, 8, 1], [7, 2, 5, 3, 9], [1, 9, 2, 6, 4], [8, 3, 7, 2, 5]], float)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, f"f{j}", float(SMALL[i, j])) for i in range(6) for j in range(5)]
    return spark.createDataFrame(rows, "user_id long, feature string, value double")


def table(df, row, feature, value):
    pdf = df.toPandas().pivot(index=row, columns=feature, values=value)
    return pdf.sort_index().to_numpy()


def test_scaling(small, spark):
    z = (SMALL - SMALL.mean(0)) / SMALL.std(0)
    assert table(X.standardise(small), "user_id", "feature", "value") == pytest.approx(z)
    assert table(X.minmax(small), "user_id", "feature", "value") == pytest.approx((SMALL - SMALL.min(0)) / np.ptp(SMALL, axis=0))
    assert table(X.l2_normalise(small), "user_id", "feature", "value") == pytest.approx(SMALL / np.linalg.norm(SMALL, axis=1, keepdims=True))
    sparse = spark.createDataFrame([(1, "a", 2.0), (2, "b", 5.0), (1, "b", 5.0)], "user_id long, feature string, value double")
    got = {(r.user_id, r.feature): r.value for r in X.standardise(sparse).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): -1.0, (1, "b"): 0.0, (2, "b"): 0.0}  # absent = 0, constant = 0


def test_pca_small(small, spark):
    names = X.feature_names(small)
    model = X.pca(X.to_vectors(small, names), names)
    z = (SMALL - SMALL.mean(0)) / SMALL.std(0)
    assert model.values == pytest.approx(np.linalg.eigvalsh(z.T @ z / 5)[::-1])
    assert model.values.sum() == pytest.approx(5 * 6 / 5)
    scores = X.pca_scores(X.to_vectors(small, names), model).orderBy("user_id").toPandas()["scores"]
    assert np.stack(scores) == pytest.approx(z @ model.loadings)
    t = model.table(spark)
    assert t.groupBy("pc").agg(F.sum(F.col("loading") * F.col("loading")).alias("s")).toPandas()["s"].to_numpy() == pytest.approx(np.ones(5))
    assert X.pc_contribution(t, 5).agg(F.sum("contribution")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("alpha,beta", [(0, 0), (1, 1), (0.7, 0.7), (1, 0), (0, 1)])
def test_rmt_clean(small, alpha, beta):
    names = X.feature_names(small)
    v = X.to_vectors(small, names)
    model = X.pca(v, names)
    got = np.stack(X.rmt_clean(v, model, alpha, beta, [1, 3]).orderBy("user_id").toPandas()["cleaned"])
    z = (SMALL - SMALL.mean(0)) / SMALL.std(0)
    want = z - beta * np.outer(z @ model.loadings[:, 0], model.loadings[:, 0]) - alpha * np.outer(z @ model.loadings[:, 2], model.loadings[:, 2])
    assert got == pytest.approx(want)


def test_corr_many_blocks_and_slices(spark, sf):
    f = features(spark, sf).where("vec_id < 120")
    x = f.toPandas().pivot(index="vec_id", columns="feature", values="value").to_numpy()
    want = np.corrcoef(x.T)
    for block, cells in ((512, 4_000_000), (10, 200)):
        got = corr_matrix(f, "feature", "vec_id", block=block, slice_cells=cells).toPandas()
        assert len(got) == 64 * 63 // 2 and (got.u < got.v).all()
        assert got.rho.to_numpy() == pytest.approx(want[got.u, got.v], abs=1e-9)


def test_corr_counts_absent_cells_as_zero(spark):
    cells = [(1, "a", 1.0), (2, "b", 1.0), (3, "a", 2.0), (3, "b", 1.0), (4, "c", 7.0)]
    df = spark.createDataFrame(cells, "v long, o string, value double")
    dense = np.array([[1, 0, 0], [0, 1, 0], [2, 1, 0], [0, 0, 7.0]])
    got = corr_matrix(df, "v", "o", block=2, slice_cells=1).toPandas()
    assert len(got) == 6
    assert got.rho.to_numpy() == pytest.approx(np.corrcoef(dense)[got.u - 1, got.v - 1])


def planted(n_cols=20, n_obs=200, n_fact=3, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n_obs, n_cols)) + rng.normal(size=(n_obs, n_fact)) @ rng.normal(size=(n_fact, n_cols))


def test_denoise_and_detone(spark):
    x = planted()
    rho = np.corrcoef(x.T)
    i, j = np.triu_indices(20, 1)
    corr = spark.createDataFrame([(int(a), int(b), float(rho[a, b])) for a, b in zip(i, j)], "u long, v long, rho double")
    for fn in (X.denoise_corr, X.detone_corr):
        names, clean = X.symmetric(fn(corr, 0.1), "u", "v", "rho", 1.0)
        assert names == list(range(20)) and np.diag(clean) == pytest.approx(np.ones(20))
        assert np.abs(clean).max() <= 1 + 1e-12
    values = np.linalg.eigvalsh(X.symmetric(X.denoise_corr(corr, 0.1), "u", "v", "rho", 1.0)[1])
    small = values[values < 0.9]
    assert len(small) >= 15 and np.ptp(small) < np.ptp(np.linalg.eigvalsh(rho)[: len(small)])


def test_variance_fit_finds_the_noise_level(spark):
    rng = np.random.default_rng(3)
    q, sigma2 = 0.25, 0.6
    values = np.linalg.eigvalsh(np.cov(rng.normal(scale=sigma2**0.5, size=(1200, 300)).T))
    df = spark.createDataFrame([(float(v),) for v in values], "eigenvalue double")
    fit = X.mp_variance_fit(df, q, width=0.05).first()
    assert fit.variance == pytest.approx(sigma2, abs=0.06)


def test_rmt_classifier(spark):
    rng = np.random.default_rng(5)
    inside = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 12)) * 3 + rng.normal(size=(300, 12)) * 0.1
    outside = rng.normal(size=(50, 12)) * 3
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    model = X.rmt_classifier_fit(frame(inside), train_cutoff=0.95)
    assert model.basis.shape == (12, 2)
    res = np.sort(np.linalg.norm(inside - inside @ model.basis @ model.basis.T, axis=1))
    assert model.epsilon == pytest.approx(res[int(0.95 * 300)])
    assert model.predict(frame(inside)).agg(F.sum("prediction")).first()[0] == int(0.95 * 300)
    assert model.predict(frame(outside)).agg(F.sum("prediction")).first()[0] == 0


def test_kmo_matches_numpy(spark, sf):
    f = features(spark, sf).where("feature < 6")
    r = np.corrcoef(f.toPandas().pivot(index="vec_id", columns="feature", values="value").to_numpy().T)
    inv = np.linalg.inv(r)
    partial = inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(6, dtype=bool)
    want = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    got = bartlett_kmo(f, "feature", "vec_id").first()
    assert got.kmo == pytest.approx(want) and got.df1 == 15 and 0 <= got.p_value <= 1


def test_feature_guard(spark, sf):
    with pytest.raises(ValueError, match="features"):
        X.feature_names(features(spark, sf), limit=10)
    with pytest.raises(ValueError, match="features"):
        X.moments(vectors(spark, sf), limit=10)


@pytest.mark.parametrize("block,slice_cells", [(2, 20), (3, 7), (512, 50), (1, 1)])
def test_corr_sparse_in_any_blocks(spark, block, slice_cells):
    r = np.random.default_rng(block)
    dense = np.where(r.random((120, 7)) < 0.1, r.normal(5, 2, (120, 7)), 0.0)
    dense[:, 6] = r.normal(1000, 1, 120)
    cells = [(int(j), f"o{i}", float(dense[i, j])) for i in range(120) for j in range(7) if dense[i, j] != 0]
    df = spark.createDataFrame(cells, "v long, o string, value double")
    got = corr_matrix(df, "v", "o", block=block, slice_cells=slice_cells).toPandas()
    assert len(got) == 21
    assert got.rho.to_numpy() == pytest.approx(np.corrcoef(dense.T)[got.u, got.v], abs=1e-9)


def test_corr_pairs_are_not_joined(spark):
    """A join of the pairs was planned as a broadcast from the size of the input."""
    rng = np.random.default_rng(8)
    dense = rng.integers(0, 4, (9, 40)).astype(float)  # observation x variable
    dense[:, 7] = 2.0
    df = spark.createDataFrame([(f"v{j:02d}", i, float(dense[i, j])) for i in range(9) for j in range(40) if dense[i, j]], "v string, o int, value double")
    got = corr_matrix(df, "v", "o", block=11)
    assert "Join" not in got._jdf.queryExecution().toString()
    got, sliced = (d.toPandas().sort_values(["u", "v"], ignore_index=True) for d in (got, corr_matrix(df, "v", "o", block=11, slice_cells=30)))
    assert len(got) == 780 and (got.u < got.v).all()
    assert (got.rho.isna() == ((got.u == "v07") | (got.v == "v07"))).all()
    i, j = got.u.str[1:].astype(int), got.v.str[1:].astype(int)
    want = np.corrcoef(np.delete(dense, 7, axis=1).T)
    keep = got.rho.notna()
    at = lambda k: (k - (k > 7))[keep].to_numpy()
    assert got.rho[keep].to_numpy() == pytest.approx(want[at(i), at(j)])
    assert sliced.rho.to_numpy() == pytest.approx(got.rho.to_numpy(), nan_ok=True)


def test_many_users_as_variables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (9, 60)).astype(float)  # moves x users
    x[:, 3] = 1.0
    df = spark.createDataFrame([(j, f"m{i}", float(x[i, j])) for i in range(9) for j in range(60) if x[i, j]], "user_id long, feature string, value double")
    monkeypatch.setattr(X, "MAX_FEATURES", 9)  # one matrix of users would be refused
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    values, vecs = X._eigh(z.T @ z / 8)
    for pc in (1, 2):
        got = X.variables_pca(df, pc).toPandas().sort_values("feature")
        assert got.loading.to_numpy() == pytest.approx(vecs[:, pc - 1], abs=1e-9)
        assert got.eigenvalue.iloc[0] == pytest.approx(values[pc - 1])
    with pytest.raises(ValueError):
        X.variables_pca(df, 9)


def test_corr_slices_hold_a_quarter_of_the_cells_in_one_block(spark, monkeypatch):
    from pathlore.operators import stats

    asked = []
    monkeypatch.setattr(stats, "_corr_sliced", lambda cells, n, blocks, slices: asked.append((n, blocks, slices)))
    for n in (200, 1000):
        df = spark.range(4 * n).selectExpr("id % 4 as v", "id div 4 as o", "cast(id % 7 as double) as value")
        stats.corr_matrix(df, "v", "o", slice_cells=400)
    assert asked == [(200, 1, 8), (1000, 1, 40)]  # 100 cells a task whatever the number of observations


def test_corr_many_variables_are_copied_to_few_blocks(spark, monkeypatch):
    # 70 variables in blocks of 2 used to be copied 35 times each
    from pathlore.functions import ordered

    rng = np.random.default_rng(8)
    dense = rng.integers(0, 3, size=(70, 7)).astype(float)
    dense[5] = 2.0  # no correlation with a constant
    rows = [(int(v), int(o), float(dense[v, o])) for v, o in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(rows, "v long, o long, value double")
    seen, copies = [], ordered.blocked_pairs
    monkeypatch.setattr(ordered, "blocked_pairs", lambda d, key, blocks: seen.append(blocks) or copies(d, key, blocks))
    got = {(r.u, r.v): r.rho for r in corr_matrix(df, "v", "o", block=2).collect()}
    assert seen == [ordered.MANY_BLOCKS]
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(dense)
    assert set(got) == {(u, v) for u in range(70) for v in range(u + 1, 70)} and len(got) == 70 * 69 // 2
    for (u, v), rho in got.items():
        assert rho is None if np.isnan(want[u, v]) else abs(rho - want[u, v]) < 1e-12


@pytest.mark.parametrize("rows,block,cells,want", [(9_000, 1024, 1, 9), (90_000, 1024, 1, 16), (540_000, 1024, 1, 33), (5, 1024, 1, 1), (0, 1024, 1, 1), (90_000, 1024, 900, 81)])
def test_blocks_of_pairs_grow_slower_than_rows(rows, block, cells, want):
    from pathlore.functions.ordered import pair_blocks

    assert pair_blocks(rows, block, cells, 2_000_000) == want
