from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.operators import predict as R
from pathlore.operators import similarity as Y
from pathlore.plans.predict_queries import _data
from pathlore.plans.tables import vectors


def arrays(df):
    pdf = df.orderBy("id").toPandas()
    return pdf["id"].to_numpy(), pdf["label"].to_numpy(), np.stack(pdf["vec"])


@pytest.mark.parametrize("block", [4096, 60])
def test_knn_is_exact_over_blocks(spark, sf, block):
    train, test = R.split(_data(spark, sf))
    ids, y, x = arrays(train)
    tid, _, tx = arrays(test)
    d = ((tx[:, None] - x[None]) ** 2).sum(2)
    want = [y[np.lexsort((ids, row))[:5]].mean() for row in d]
    got = R.knn_classify(train, test, 5, block=block).orderBy("id").toPandas()
    assert list(got["id"]) == list(tid) and got["score"].to_numpy() == pytest.approx(want)


def test_lda_matches_numpy(spark, sf):
    data = _data(spark, sf)
    _, y, x = arrays(data)
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    within = ((x[y == 0] - m0).T @ (x[y == 0] - m0) + (x[y == 1] - m1).T @ (x[y == 1] - m1)) / (len(y) - 2)
    w = np.linalg.solve(within, m1 - m0)
    z = x @ w - 0.5 * (m0 + m1) @ w + np.log((y == 1).sum() / (y == 0).sum())
    got = R.lda_classify(data, data).orderBy("id").toPandas()["score"]
    assert got.to_numpy() == pytest.approx(1 / (1 + np.exp(-z)))


def test_split_and_folds_partition_the_rows(spark, sf):
    data = _data(spark, sf)
    train, test = R.split(data)
    assert train.count() + test.count() == data.count() and train.join(test, "id").count() == 0
    assert 0.1 < test.count() / data.count() < 0.3
    report = R.cv10(data, R.algorithms(64)["LDA"])
    total = report.agg(*[F.sum(c) for c in ("tp", "fp", "tn", "fn")]).first()
    assert report.count() == 10 and sum(total) == data.count()


def test_separable_data_is_learned_by_all(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    rows = [(i, int(r[0] > 0), [float(3 * r[0] + np.sign(r[0])), float(r[1]), float(r[2])]) for i, r in enumerate(x)]
    data = spark.createDataFrame(rows, "id long, label long, vec array<double>")
    report, models = R.train_eval_all(data, R.algorithms(3, trees=3))
    got = {r.algorithm: r for r in report.collect()}
    assert set(got) == set(models) and all(r.accuracy > 0.85 and r.auc > 0.9 for r in got.values())
    top = R.feature_importance(models["Random Forest"], ["a", "b", "c"], spark).first()
    assert top.feature == "a"


def test_kernel_svm_finds_a_ring(spark):
    """A ring around a disc: no plane parts them, the kernel does, and its probabilities fit the rates."""
    rng = np.random.default_rng(2)
    turn, far = rng.uniform(0, 2 * np.pi, 600), np.where(np.arange(600) % 2, rng.uniform(0, 1, 600), rng.uniform(1.3, 2.3, 600))
    rows = [(i, i % 2, [float(far[i] * np.cos(turn[i])), float(far[i] * np.sin(turn[i]))]) for i in range(600)]
    data = spark.createDataFrame(rows, "id long, label long, vec array<double>").coalesce(1)
    algos = R.algorithms(2)
    report, _ = R.train_eval_all(data, {n: algos[n] for n in ("SVM", "Kernel SVM")})
    got = {r.algorithm: r for r in report.collect()}
    assert got["Kernel SVM"].accuracy > 0.93 > 0.75 > got["SVM"].accuracy and got["Kernel SVM"].auc > 0.97
    scores = R.kernel_svm_fit(data)[0](data)
    assert scores.columns == ["id", "label", "vec", "score"] and scores.where("score < 0 or score > 1").count() == 0
    assert abs(scores.agg(F.avg("score")).first()[0] - 0.5) < 0.1


def test_adaboost_rounds_equal_brute_force(spark):
    """Votes and scores against stumps found by trying every feature and every midpoint."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.permutation(26) for _ in range(3)], axis=1).astype(float)
    y = ((x[:, 0] > 8) & (x[:, 1] < 19) ^ (rng.random(26) < 0.15)).astype(int)
    w, votes, total = np.full(26, 1 / 26), [], np.zeros(26)
    for _ in range(4):
        best = None
        for f in range(3):
            for cut in np.arange(0.5, 25):
                left = x[:, f] <= cut
                gini = 0.0
                for side in (left, ~left):
                    one = w[side & (y == 1)].sum() / w[side].sum()
                    gini += w[side].sum() * 2 * one * (1 - one)
                if best is None or gini < best[0] - 1e-12:
                    best = gini, left
        left = best[1]
        guess = np.empty(26, dtype=int)
        for side in (left, ~left):
            guess[side] = w[side & (y == 1)].sum() > w[side & (y == 0)].sum()
        error = w[guess != y].sum() / w.sum()
        votes.append(np.log((1 - error) / error))
        total += votes[-1] * (2 * guess - 1)
        w = np.where(guess != y, w * (1 - error) / error, w)
        w /= w.sum()
    data = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(26)], "id long, label long, vec array<double>").coalesce(1)
    score, found = R.adaboost_fit(data, rounds=4, depth=1)
    assert [v for v, _ in found] == pytest.approx(votes)
    got = score(data).orderBy("id").toPandas()["score"].to_numpy()
    assert got == pytest.approx(1 / (1 + np.exp(-total / sum(votes))))
    sure = data.select("id", "label", F.array(F.col("label").cast("double")).alias("vec"))
    score, found = R.adaboost_fit(sure, rounds=4, depth=1)
    assert len(found) == 1 and R.decision(score(sure)).where("prediction <> label").count() == 0


def test_metrics_edges(spark):
    rows = [(1, 1, 0.9), (0, 1, 0.9), (0, 0, 0.1), (1, 0, 0.2)]
    m = R.metrics(spark.createDataFrame(rows, "label long, prediction long, score double")).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (1, 1, 1, 1) and m.auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    only = R.metrics(spark.createDataFrame([(0, 0, 0.3)], "label long, prediction long, score double")).first()
    assert only.precision == 0 and only.recall == 0 and only.auc is None


def test_save_and_load(spark, sf, tmp_path):
    from pyspark.ml.functions import array_to_vector

    data = _data(spark, sf)
    _, model = R.algorithms(64)["Logistic Regression"](data)
    R.save_model(model, str(tmp_path / "m"))
    feat = data.withColumn("features", array_to_vector("vec"))
    a = R.load_model(str(tmp_path / "m")).transform(feat).select("id", "prediction").collect()
    b = model.transform(feat).select("id", "prediction").collect()
    assert sorted(a) == sorted(b)


def test_report_and_best(spark):
    cols = "week long, scenario string, algorithm string, f1 double"
    report = spark.createDataFrame([(0, "o", "b", 0.5), (0, "o", "a", 0.5), (1, "o", "b", 0.9)], cols)
    assert {(r.week, r.algorithm) for r in R.best_algorithm(report).collect()} == {(0, "a"), (1, "b")}


@pytest.mark.parametrize("block,slices", [(256, 64), (7, 2)])
def test_code_similarity_over_blocks(spark, sf, block, slices):
    v = vectors(spark, sf).where("vec_id % 7 <> 3").select((F.col("vec_id") % 30).alias("user_id"), F.floor(F.col("vec_id") / 30).alias("task"), "vec")
    pdf = v.toPandas()
    by = {u: {t: np.array(x) for t, x in zip(g["task"], g["vec"])} for u, g in pdf.groupby("user_id")}
    got = Y.user_code_similarity(v, block, slices).collect()
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a <= b and both:
                x, y = np.concatenate([by[a][t] for t in both]), np.concatenate([by[b][t] for t in both])
                want[(a, b)] = x @ y / np.sqrt((x @ x) * (y @ y))
    assert {(r.u, r.v) for r in got} == set(want)
    assert all(r.similarity == pytest.approx(want[(r.u, r.v)]) for r in got)


def test_code_tokens(spark):
    df = spark.createDataFrame([("a  b\n\nc\td  \n",), ("one",), ("",)], "upload string")
    assert [r.tokens for r in Y.code_tokens(df).collect()] == [["c", "d"], [], []]


def test_knn_keeps_order_of_copies_and_far_vectors(spark):
    """Rough distances by products choose candidates only: far from the origin all digits are lost in them."""

    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (60, 4)) + np.array([1e8, 0, 0, 0])
    rows = [(i, i % 2, [float(v) for v in x[i % 45]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<double>")
    got = {r.id: r.score for r in R.knn_classify(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), 5, block=20).collect()}
    for i in range(0, 60, 4):
        near = sorted((sum((a - b) ** 2 for a, b in zip(rows[i][2], v)), j, y) for j, y, v in rows if j % 4)[:5]
        assert got[i] == pytest.approx(sum(y for _, _, y in near) / 5)


def test_every_test_row_is_scored_once(spark, sf):
    seen = spark.sparkContext.accumulator(0)

    def fit(train):
        def rows(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return lambda test: test.mapInArrow(rows, test.schema).withColumn("score", F.lit(0.7)), len(train.columns)

    data = _data(spark, sf)
    report, models = R.train_eval_all(data, {"b": fit, "a": fit})
    assert [r["algorithm"] for r in report.orderBy("algorithm").collect()] == ["a", "b"] and models == {"b": 3, "a": 3}
    assert seen.value == 2 * R.split(data)[1].count()


def test_train_eval_all_query_grows_all_trees(spark, tmp_path, monkeypatch):
    # the query used to ask for ten trees and ten rounds of boosting
    from pathlore.plans import predict_queries as Q

    rows = [(i, [float((i * k) % 7) for k in range(1, 65)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    given = []
    monkeypatch.setattr(Q.R, "train_eval_all", lambda data, algos: given.append((data, algos)) or (spark.range(1), {}))
    Q.train_eval_all(spark, str(tmp_path))
    (data, algos), = given
    assert data.count() == 40 and list(algos) == list(R.algorithms(64))
    assert algos["Random Forest"](data)[1].getNumTrees == R.algorithms(64)["Random Forest"](data)[1].getNumTrees == 200
