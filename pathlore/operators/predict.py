"""Outcome prediction: feature sets, classifiers, evaluation and reports.

Data frames carry ``id``, ``label`` (1 excellent, 0 weak) and ``vec`` array<double>. Every
classifier turns a test frame into the same frame with ``score``, its probability of label 1.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, value_ranks
from pathlore.operators.spectral import _apply, _gram
from pathlore.session import cut_lineage

METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc", "auc")


def labelled_features(features: DataFrame, excellent: DataFrame, weak: DataFrame, practice: DataFrame | None = None, on: str = "user_id") -> DataFrame:
    """Feature rows of both cohorts with ``result`` 1 / 0, beside practice columns where given."""
    marks = excellent.select(on, F.lit(1).cast("long").alias("result")).unionByName(weak.select(on, F.lit(0).cast("long").alias("result")))
    out = features.join(marks, on)
    return out.join(practice, on) if practice is not None else out


def split(data: DataFrame, test_share: float = 0.2, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Deterministic hash split: the same rows at every run and on every cluster."""
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000))
    return data.where(place >= int(test_share * 10_000)), data.where(place < int(test_share * 10_000))


# ---- classifiers ----------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]


def _ml_scorer(estimator) -> Callable[[DataFrame], tuple[Scorer, object]]:
    def fit(train: DataFrame) -> tuple[Scorer, object]:
        model = estimator.fit(train.select("label", array_to_vector("vec").alias("features")))

        def score(test: DataFrame) -> DataFrame:
            done = model.transform(test.withColumn("features", array_to_vector("vec")))
            if "probability" in done.columns:
                p1 = F.get(vector_to_array("probability"), F.lit(1))
            else:  # a margin: its sign decides
                p1 = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
            return done.withColumn("score", p1).select(*test.columns, "score")

        return score, model

    return fit


def knn_classify(train: DataFrame, test: DataFrame, k: int = 7, block: int | None = None) -> DataFrame:
    """Share of label 1 among the k nearest training rows (ties: smaller id), as ``score``.

    Training and test rows are hashed to blocks; each block pair yields its own k nearest per
    test row, and the k best of those few candidates are kept. Exact, and no task holds more than
    one block of either side.
    """
    head = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("p")).first()
    n_train, n_test = head["n"], test.count()
    # large blocks mean few copies of each row; about 32 MB of vectors per side and task
    block = block or max(256, min(65_536, 4_000_000 // max(1, head["p"] or 1)))
    bt, bq = max(1, -(-n_train // block)), max(1, -(-n_test // block))
    kind = dict(test.dtypes)["id"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = train.select("id", "label", "vec", F.lit(0).alias("_side"), own(bt).alias("_t"), every(bq).alias("_q"))
    right = test.select("id", F.lit(None).cast("long").alias("label"), "vec", F.lit(1).alias("_side"), own(bq).alias("_q"), every(bt).alias("_t"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0].sort_values("id"), pdf[pdf["_side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "near": [], "label": [], "dist": []})
        x, y = np.stack(a["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
        size = max(1, 4_000_000 // len(x))  # test rows whose products fit about 32 MB
        width, near_most = max(1, 8_000_000 // x.shape[1]), min(k, len(x))
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        parts = []
        for s in range(0, len(y), size):
            # products tell which rows may be among the nearest; their distances are then summed without cancellation
            rough = yy[s : s + size, None] + xx[None, :] - 2 * (y[s : s + size] @ x.T)
            limit = np.partition(rough, near_most - 1, axis=1)[:, near_most - 1] + 1e-10 * (xx.max() + yy[s : s + size])
            i, j = np.nonzero(~(rough > limit[:, None]))
            d = np.concatenate([((y[s + i[c : c + width]] - x[j[c : c + width]]) ** 2).sum(axis=1) for c in range(0, len(i), width)])
            by = np.lexsort((j, d, i))
            i, j, d = i[by], j[by], d[by]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d = i[kept], j[kept], d[kept]
            near, label = a["id"].to_numpy()[j], a["label"].to_numpy()[j].astype("int64")
            parts.append(pd.DataFrame({"id": b["id"].to_numpy()[s + i], "near": near, "label": label, "dist": d}))
        return pd.concat(parts)

    found = left.unionByName(right).groupBy("_t", "_q").applyInPandas(nearest, f"id {kind}, near {kind}, label long, dist double")
    # at most k * bt candidates per test row
    best = found.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("dist", "near"))).where(F.col("_rn") <= k)
    votes = best.groupBy("id").agg(F.avg("label").alias("score"))
    return test.join(votes, "id")


def _fit_knn(k: int) -> Callable[[DataFrame], tuple[Scorer, object]]:
    return lambda train: (lambda test: knn_classify(train, test, k), None)


def lda_fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """Linear discriminant: weights and offset from class means and the pooled covariance."""
    rows = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("m")).collect()
    stats = {r["label"]: (r["n"], np.array(r["m"])) for r in rows}  # one row per class
    n = sum(v[0] for v in stats.values())
    within = sum(_gram(train.where(F.col("label") == c), "vec", m) for c, (_, m) in stats.items()) / (n - len(stats))
    (n0, m0), (n1, m1) = stats[0], stats[1]
    w = np.linalg.pinv(within) @ (m1 - m0)
    return w, float(-0.5 * (m0 + m1) @ w + np.log(n1 / n0))


def lda_classify(train: DataFrame, test: DataFrame) -> DataFrame:
    w, b = lda_fit(train)
    p = len(w)
    lin = _apply(test, "vec", "_z", np.zeros(p), np.ones(p), w.reshape(-1, 1))
    return lin.withColumn("score", 1 / (1 + F.exp(-(F.get("_z", F.lit(0)) + b)))).drop("_z")


def kernel_svm_fit(train: DataFrame, half: int = 256, seed: int = 5) -> tuple[Scorer, object]:
    """Linear support-vector machine on random Fourier features of the Gaussian kernel.

    ``half`` frequencies give a cosine and a sine each; the kernel's width is 1 / (p * variance of all
    entries). Probabilities are the logistic curve of margins that a machine fitted on four fifths of
    the rows gives the other fifth (by hash of the id); both classes should occur in either part.
    """
    sums = F.struct(*[F.aggregate("vec", F.lit(0.0), f).alias(n) for n, f in (("s", lambda a, x: a + x), ("q", lambda a, x: a + x * x))])
    head = train.select(F.size("vec").alias("p"), sums.alias("t")).agg(F.max("p").alias("p"), F.sum("p").alias("n"), F.sum("t.s").alias("s"), F.sum("t.q").alias("q")).first()
    p, variance = head["p"], max(head["q"] / head["n"] - (head["s"] / head["n"]) ** 2, 1e-12)
    waves = np.random.default_rng(seed).normal(size=(p, half)) * np.sqrt(2 / (p * variance))

    def features(df: DataFrame) -> DataFrame:
        turned = _apply(df, "vec", "_z", np.zeros(p), np.ones(p), waves)
        return turned.withColumn("features", array_to_vector(F.concat(F.transform("_z", F.cos), F.transform("_z", F.sin)))).drop("_z")

    def margins(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("_m", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rawPrediction", "prediction")

    rows = cut_lineage(features(train.select("id", "label", "vec")).drop("vec"))
    solver = LinearSVC(maxIter=100, regParam=0.01)
    apart, kept = split(rows, 0.2, seed + 7919)  # another hash than that of the rows given
    curve = LogisticRegression(featuresCol="_v", regParam=0.001).fit(margins(solver.fit(apart), kept).select("label", F.array("_m").alias("_a")).withColumn("_v", array_to_vector("_a")))
    slope, shift, model = float(curve.coefficients[0]), float(curve.intercept), solver.fit(rows)

    def score(test: DataFrame) -> DataFrame:
        return margins(model, features(test)).withColumn("score", 1 / (1 + F.exp(-(slope * F.col("_m") + shift)))).select(*test.columns, "score")

    return score, model


def adaboost_fit(train: DataFrame, rounds: int = 200, depth: int = 5, seed: int = 5) -> tuple[Scorer, list]:
    """Adaptive boosting of trees: rows that the last tree got wrong weigh (1 - e) / e times as much
    in the next, where e is the tree's weighted error.

    Ends early after a tree without error, which then votes as much as one with an error of 1e-10,
    or before one that is wrong on half of the weight. The score is the logistic curve of the mean
    vote; the model is the list of (vote, tree). Weights are kept in a written table per round.
    """
    state = cut_lineage(train.select("label", array_to_vector("vec").alias("features"), F.lit(1.0).alias("w")))
    state = cut_lineage(state.withColumn("w", 1.0 / F.lit(float(max(state.count(), 1)))))
    votes: list = []
    for _ in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, seed=seed, weightCol="w").fit(state)
        tree.setProbabilityCol("").setRawPredictionCol("")
        seen = tree.transform(state).withColumn("_wrong", F.col("prediction") != F.col("label"))
        error = seen.agg(F.coalesce(F.sum(F.when(F.col("_wrong"), F.col("w"))), F.lit(0.0)) / F.sum("w")).first()[0]
        if error >= 0.5 and votes:
            break
        vote = float(np.log((1 - max(error, 1e-10)) / max(error, 1e-10)))
        votes.append((vote, tree))
        if error <= 1e-10 or error >= 0.5:
            break
        # the weights of one round sum to one
        state = cut_lineage(seen.select("label", "features", (F.col("w") * F.when(F.col("_wrong"), 0.5 / error).otherwise(0.5 / (1 - error))).alias("w")))

    def score(test: DataFrame) -> DataFrame:
        done, total = test.withColumn("features", array_to_vector("vec")), sum(abs(v) for v, _ in votes) or 1.0
        for k, (_, tree) in enumerate(votes):
            done = tree.copy().setPredictionCol(f"_p{k}").transform(done)
        mean = reduce(Column.__add__, [F.lit(v / total) * (2 * F.col(f"_p{k}") - 1) for k, (v, _) in enumerate(votes)])
        return done.withColumn("score", 1 / (1 + F.exp(-mean))).select(*test.columns, "score")

    return score, votes


def algorithms(p: int, trees: int = 200, k: int = 7, seed: int = 5) -> dict[str, Callable]:
    """Name -> fit(train) -> (scorer, model)."""
    # Display names and settings of the algorithms.
    return {
        "Logistic Regression": _ml_scorer(LogisticRegression(maxIter=100)),
        "Decision Tree": _ml_scorer(DecisionTreeClassifier(maxDepth=5, seed=seed)),
        "Random Forest": _ml_scorer(RandomForestClassifier(numTrees=trees, seed=seed)),
        "Gradient Boosting": _ml_scorer(GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.05, seed=seed)),
        "AdaBoost": lambda train: adaboost_fit(train, trees, 5, seed),
        "SVM": _ml_scorer(LinearSVC(maxIter=100)),
        "Kernel SVM": lambda train: kernel_svm_fit(train, seed=seed),
        "Multi Layer Nets": _ml_scorer(MultilayerPerceptronClassifier(layers=[p, 128, 64, 2], maxIter=100, seed=seed)),
        "KNN": _fit_knn(k),
        "LDA": lambda train: (lambda test: lda_classify(train, test), None),
    }


# ---- evaluation -----------------------------------------------------------------------------


def decision(scored: DataFrame, threshold_as_zero: float = 0.5) -> DataFrame:
    """prediction = 0 if P(0) reaches the threshold, else 1."""
    return scored.withColumn("prediction", F.when(1 - F.col("score") >= threshold_as_zero, 0).otherwise(1).cast("long"))


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall = zero(F.try_divide(tp, tp + fn))
    return {
        "accuracy": (tp + tn) / (tp + fp + tn + fn),
        "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "precision": zero(F.try_divide(tp, tp + fp)),
        "recall": recall,
        # area under the one-point curve of the hard decisions
        "roc_auc": (recall + zero(F.try_divide(tn, tn + fp))) / 2,
    }


def metrics(predicted: DataFrame, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Counts of the confusion matrix and all measures from (label, prediction, score).

    ``roc_auc`` rates the hard decisions; ``auc`` is the rank-sum area under the score curve.
    """
    cell = {
        n: F.count_if((F.col("label") == y) & (F.col("prediction") == h)).alias(n)
        for n, y, h in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))
    }
    counts = predicted.groupBy(*by).agg(*cell.values())
    counts = counts.withColumns(_rates(*[F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")]))
    pos = {"p": F.count_if(F.col("label") == 1), "n": F.count(F.lit(1))}
    ranks = value_ranks(predicted, list(by), "score", pos, policy)
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    area = ranks.groupBy(*by).agg(F.sum(F.col("p") * mean_rank).alias("_r"), F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    auc = F.try_divide(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p")))
    area = area.select(*by, auc.alias("auc"))
    if by:
        return counts.join(area, list(by), "left")
    return counts.withColumn("auc", area.scalar())


def train_eval_all(data: DataFrame, algos: dict[str, Callable], seed: int = 5, parallelism: int = 4) -> tuple[DataFrame, dict]:
    """Fits each algorithm on 80 % and reports its measures on the rest; also the fitted models.

    ``parallelism`` algorithms are fitted at a time, as many iterations are short jobs that leave cores
    idle. Rows are dealt to all cores first, unless they are few. Scores are written once, the
    measures read them.
    """
    spark = data.sparkSession
    # by the id's hash, so a task that runs again deals the same rows
    dealt = data.repartition(min(2 * spark.sparkContext.defaultParallelism, data.count() // 4096 + 1), "id")
    train, test = (d.persist() for d in split(dealt, 0.2, seed))

    def run(name: str) -> tuple[DataFrame, object]:
        scorer, model = algos[name](train)
        return cut_lineage(decision(scorer(test)).select("label", "prediction", "score", F.lit(name).alias("algorithm"))), model

    with ThreadPoolExecutor(parallelism) as pool:
        # the widest fits last longest and begin first; the report keeps the order given
        jobs = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in reversed(algos)}
        done = {name: jobs[name].result() for name in algos}
    train.unpersist()
    test.unpersist()
    return metrics(reduce(DataFrame.unionByName, [d for d, _ in done.values()]), ("algorithm",)), {n: m for n, (_, m) in done.items()}


def cv10(data: DataFrame, fit: Callable, folds: int = 10, seed: int = 5) -> DataFrame:
    """Measures per fold; a row belongs to the fold of its hash."""
    placed = data.withColumn("_fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds))).persist()
    parts = []
    for k in range(folds):
        scorer, _ = fit(placed.where(F.col("_fold") != k).drop("_fold"))
        parts.append(decision(scorer(placed.where(F.col("_fold") == k).drop("_fold"))).select("label", "prediction", "score", F.lit(k).cast("long").alias("fold")))
    return metrics(reduce(DataFrame.unionByName, parts), ("fold",))


def feature_importance(model, names: list, spark) -> DataFrame:
    """Importances of a tree model, largest first (one row per feature)."""
    rows = sorted(zip(map(str, names), (float(x) for x in model.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def weekly_report(reports: dict[int, DataFrame], cv: dict[tuple[int, str], DataFrame] | None = None, scenario: str = "original") -> DataFrame:
    """week x algorithm table; ``cv`` adds the mean cross-validated area."""
    parts = [r.select(F.lit(w).cast("long").alias("week"), F.lit(scenario).alias("scenario"), "algorithm", *METRICS) for w, r in reports.items()]
    out = reduce(DataFrame.unionByName, parts)
    if cv:
        means = reduce(
            DataFrame.unionByName,
            [d.agg(F.avg("auc").alias("cv_mean")).select(F.lit(w).cast("long").alias("week"), F.lit(a).alias("algorithm"), "cv_mean") for (w, a), d in cv.items()],
        )
        out = out.join(means, ["week", "algorithm"], "left")
    return out


def best_algorithm(report: DataFrame, score: str = "f1") -> DataFrame:
    """Best score per (week, scenario); ties go to the first name."""
    best = report.groupBy("week", "scenario").agg(F.min(F.struct((-F.col(score)).alias("s"), "algorithm")).alias("b"))
    return best.select("week", "scenario", (-F.col("b.s")).alias(score), F.col("b.algorithm").alias("algorithm"))


def scenarios(feature_sets: dict[str, DataFrame], algos: Callable[[int], dict], seed: int = 5) -> DataFrame:
    """The same evaluation on several feature sets: long table (scenario, algorithm, measures)."""
    parts = []
    for name, data in feature_sets.items():
        p = data.select(F.size("vec")).first()[0]
        report, _ = train_eval_all(data, algos(p), seed)
        parts.append(report.withColumn("scenario", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def scenario_table(report: DataFrame, names: list[str], score: str = "f1") -> DataFrame:
    return report.groupBy("algorithm").pivot("scenario", names).agg(F.max(score))


def cross_year(first: DataFrame, second: DataFrame, algos: dict[str, Callable]) -> DataFrame:
    """Train on one year, evaluate on the next."""
    first = first.persist()
    parts = []
    for name, fit in algos.items():
        scorer, _ = fit(first)
        parts.append(decision(scorer(second)).select("label", "prediction", "score").withColumn("algorithm", F.lit(name)))
    return metrics(reduce(DataFrame.unionByName, parts), ("algorithm",))


def relabel_by_community(results: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of a pure community replaces the exam result."""
    pure = labels.where(F.col("label").isin("excellent", "weak")).select("user_id", (F.col("label") == "excellent").cast("long").alias("_new"))
    return results.join(pure, "user_id", "left").withColumn("result", F.coalesce("_new", F.col("result").cast("long"))).drop("_new")


def save_model(model, path: str) -> None:
    """Persists a fitted Spark ML stage as a pipeline."""
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

