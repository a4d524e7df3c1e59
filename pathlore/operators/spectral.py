"""Scaling, principal components and random-matrix cleaning.

Row data stay on Spark. What reaches the driver is one symmetric p x p matrix, p checked against
``MAX_FEATURES``, which is small enough to be diagonalised there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pathlore.functions.ordered import DEFAULT, SkewPolicy, value_ranks
from pathlore.operators.stats import chi2_contingency, contingency, corr_matrix, ttest_student
from pathlore.session import cut_lineage

MAX_FEATURES = 4000
_SPREAD = 64


# ---- scaling in long form -------------------------------------------------------------------


def _grid(matrix: DataFrame, row: str, labels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Every row of each ``by`` beside every label row of it.

    The few labels are copied to ``_SPREAD`` salts, so a week with most of the rows is spread
    over that many tasks.
    """
    rows = matrix.select(*by, row).distinct().withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(_SPREAD)).cast("int"))
    copies = labels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    return rows.join(copies, [*by, "_salt"]).drop("_salt")


def dense(matrix: DataFrame, row: str, feature: str, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """All cells of the matrix per ``by``, absent ones 0."""
    grid = _grid(matrix, row, matrix.select(*by, feature).distinct(), by)
    cells = matrix.select(*by, row, feature, F.col(value).cast("double").alias(value))
    return grid.join(cells, [*by, row, feature], "left").na.fill(0.0, [value])


def _scaled(matrix: DataFrame, row: str, feature: str, value: str, by: tuple[str, ...], out: Column) -> DataFrame:
    """Dense cells as ``out`` of the cell ``_x`` and its feature's _m, _s, _lo, _hi over all rows.

    The measures come from the present cells and the number of absent zeros, so the dense form
    is built once and shuffled once.
    """
    x = F.col(value).cast("double")
    present = matrix.groupBy(*by, feature).agg(
        F.count(F.lit(1)).alias("_c"), F.avg(x).alias("_mc"), F.var_pop(x).alias("_vc"), F.min(x).alias("_lo"), F.max(x).alias("_hi")
    )
    sizes = matrix.groupBy(*by).agg(F.count_distinct(row).alias("_n"))
    present = present.join(sizes, list(by)) if by else present.withColumn("_n", sizes.scalar())
    c, n, absent = F.col("_c"), F.col("_n"), F.col("_n") > F.col("_c")
    spread = F.col("_vc") * c / n + F.col("_mc") * F.col("_mc") * c * (n - c) / (n * n)
    labels = present.select(
        *by, feature, (F.col("_mc") * c / n).alias("_m"), F.sqrt(spread).alias("_s"),
        F.when(absent, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("_lo"),
        F.when(absent, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")).alias("_hi"),
    )
    cells = matrix.select(*by, row, feature, x.alias("_x"))
    full = _grid(matrix, row, labels, by).join(cells, [*by, row, feature], "left").na.fill(0.0, ["_x"])
    return full.select(*by, row, feature, F.when(F.col("_hi") > F.col("_lo"), out).otherwise(0.0).alias(value))


def standardise(matrix: DataFrame, row: str = "user_id", feature: str = "feature", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """(x - mean) / population sd per feature with zeros counted; a constant feature becomes 0.

    ``matrix`` has at most one row per cell.
    """
    return _scaled(matrix, row, feature, value, by, (F.col("_x") - F.col("_m")) / F.col("_s"))


def minmax(matrix: DataFrame, row: str = "user_id", feature: str = "feature", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return _scaled(matrix, row, feature, value, by, (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))


def l2_normalise(matrix: DataFrame, row: str = "user_id", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    norms = matrix.groupBy(*by, row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    unit = F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).otherwise(0.0)
    return matrix.join(norms, [*by, row]).withColumn(value, unit).select(*matrix.columns)


def transpose_view(matrix: DataFrame, row: str = "user_id", feature: str = "feature") -> DataFrame:
    """Rows become variables and variables become rows."""
    return matrix.withColumnsRenamed({row: "_r", feature: row}).withColumnRenamed("_r", feature)


# ---- vectors and the p x p matrix -----------------------------------------------------------


def feature_names(matrix: DataFrame, feature: str = "feature", limit: int = MAX_FEATURES) -> list:
    """Sorted feature labels; refuses more than ``limit``."""
    names = [r[0] for r in matrix.select(feature).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} features: the p x p matrix does not fit the driver")
    return sorted(names)


def to_vectors(matrix: DataFrame, names: list, row: str = "user_id", feature: str = "feature", value: str = "value") -> DataFrame:
    """(row, vec) with absent cells 0, in the order of ``names``."""
    wide = matrix.groupBy(row).pivot(feature, names).agg(F.sum(value).cast("double"))
    vec = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in map(str, names)])
    return wide.select(row, vec.alias("vec"))


def to_long(vectors: DataFrame, names: list, row: str = "user_id", vec: str = "vec", feature: str = "feature") -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return vectors.select(row, F.posexplode(vec).alias("_i", "value")).select(row, F.get(labels, F.col("_i")).alias(feature), "value")


def _gram(vectors: DataFrame, vec: str, shift: np.ndarray) -> np.ndarray:
    """Sum of outer products of (vec - shift): one partial matrix per partition, summed row-wise."""
    p = len(shift)

    def partial(batches):
        total = np.zeros((p, p))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()) - shift
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(p), "part": list(total)})

    parts = vectors.select(vec).mapInPandas(partial, "i int, part array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
    out = np.zeros((p, p))
    for r in sums.select("i", vector_to_array("s").alias("s")).toLocalIterator():
        out[r["i"]] = r["s"]
    return (out + out.T) / 2


def moments(vectors: DataFrame, vec: str = "vec", limit: int = MAX_FEATURES) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column means and the centred cross-product matrix."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))
    head = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("p"), mean.alias("m")).first()
    if head["p"] is not None and head["p"] > limit:
        raise ValueError(f"more than {limit} features: the p x p matrix does not fit the driver")
    mean = np.array(head["m"])
    return head["n"], mean, _gram(vectors, vec, mean)


def _eigh(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, columns of eigenvectors with a positive largest entry."""
    values, vecs = np.linalg.eigh(matrix)
    values, vecs = values[::-1], vecs[:, ::-1]
    top = vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])]
    return values, vecs * np.where(top < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Pca:
    """Small result of a decomposition, kept on the driver: p names, means, scales, p x p loadings."""

    names: list
    n: int
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    loadings: np.ndarray  # feature x component

    def table(self, spark) -> DataFrame:
        """Long form: pc, eigenvalue, ratio, feature, loading."""
        p = len(self.names)
        ratio = self.values / self.values.sum()
        pdf = pd.DataFrame(
            {
                "pc": np.repeat(np.arange(1, p + 1), p),
                "eigenvalue": np.repeat(self.values, p),
                "ratio": np.repeat(ratio, p),
                "feature": np.tile(np.array(self.names, dtype=object), p),
                "loading": self.loadings.T.ravel(),
            }
        )
        kind = "long" if all(isinstance(n, (int, np.integer)) for n in self.names) else "string"
        return spark.createDataFrame(pdf, f"pc long, eigenvalue double, ratio double, feature {kind}, loading double")

    @property
    def q(self) -> float:
        return len(self.names) / self.n


def pca(vectors: DataFrame, names: list | None = None, scaled: bool = True, vec: str = "vec") -> Pca:
    """Principal components of standardised (or only centred) vectors; eigenvalues over n - 1."""
    n, mean, cross = moments(vectors, vec)
    var = np.diag(cross) / n
    scale = np.where(var > 1e-24, np.sqrt(np.maximum(var, 1e-300)), 1.0) if scaled else np.ones(len(mean))
    values, loadings = _eigh(cross / np.outer(scale, scale) / (n - 1))
    return Pca(names or list(range(len(mean))), n, mean, scale, np.maximum(values, 0.0), loadings)


def variables_pca(matrix: DataFrame, pc: int, variable: str = "user_id", observation: str = "feature", value: str = "value") -> DataFrame:
    """Loadings (pc, eigenvalue, feature, loading) of component ``pc`` where variables are many and observations few.

    The components of standardised variables, as by `pca`, from the other side: the observations'
    cross products have the same eigenvalues, and a variable's loading is its own column times their
    eigenvector. The driver holds one matrix of observations (``MAX_FEATURES`` at most), and the
    variables stay on Spark. The largest loading is positive; the smallest variable decides ties (to 9 digits).
    """
    names = feature_names(matrix, observation)
    n = len(names)
    rows = cut_lineage(to_vectors(matrix, names, variable, observation, value))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_m", total / n)
    rows = rows.withColumn("_v", F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / n)
    scale = F.when(F.col("_v") > 1e-24, F.sqrt("_v")).otherwise(1.0)
    rows = rows.withColumn("_s", scale).select(variable, F.transform("vec", lambda x: (x - F.col("_m")) / F.col("_s")).alias("vec"))
    values, sides = _eigh(_gram(rows, "vec", np.zeros(n)) / (n - 1))
    if not 1 <= pc <= n or values[pc - 1] <= 1e-12 * max(values[0], 1e-300):
        raise ValueError(f"component {pc} has no variance")
    weights = sides[:, [pc - 1]] / np.sqrt(values[pc - 1] * (n - 1))
    found = _apply(rows, "vec", "_l", np.zeros(n), np.ones(n), weights)
    found = cut_lineage(found.select(F.col(variable).alias("feature"), F.get("_l", F.lit(0)).alias("loading")))
    largest = found.agg(F.min(F.struct((-F.round(F.abs("loading"), 9)).alias("a"), "feature", "loading")).alias("t")).first()["t"]
    sign = -1.0 if largest["loading"] < 0 else 1.0
    return found.select(
        F.lit(pc).cast("long").alias("pc"), F.lit(float(values[pc - 1])).alias("eigenvalue"), "feature", (sign * F.col("loading")).alias("loading")
    )


def _apply(vectors: DataFrame, vec: str, out: str, offset: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> DataFrame:
    """out = ((vec - offset) / scale) @ weights, one matrix product per Arrow batch."""
    shared = vectors.sparkSession.sparkContext.broadcast((offset, scale, weights))

    @F.pandas_udf(ArrayType(DoubleType()))
    def product(col: pd.Series) -> pd.Series:
        o, s, w = shared.value
        return pd.Series(list(((np.stack(col.to_numpy()) - o) / s) @ w)) if len(col) else pd.Series([], dtype=object)

    return vectors.withColumn(out, product(F.col(vec)))


def pca_scores(vectors: DataFrame, model: Pca, k: int | None = None, vec: str = "vec") -> DataFrame:
    """Adds ``scores`` array<double> of the first k components."""
    return _apply(vectors, vec, "scores", model.mean, model.scale, model.loadings[:, :k])


def scores_long(scored: DataFrame, row: str = "user_id") -> DataFrame:
    long = scored.select(row, F.posexplode("scores").alias("_i", "score"))
    return long.select(row, (F.col("_i") + 1).cast("long").alias("pc"), "score")


# ---- tables of components -------------------------------------------------------------------


def _components(table: DataFrame) -> DataFrame:
    return table.groupBy("pc").agg(F.max("eigenvalue").alias("eigenvalue"))


def num_pcs(table: DataFrame, threshold: float) -> DataFrame:
    """Cumulative ratio and 0-based index of the first component that reaches ``threshold``."""
    # at most MAX_FEATURES rows
    comps = table.groupBy("pc").agg(F.max("ratio").alias("ratio"))
    cum = comps.select("pc", F.sum("ratio").over(Window.orderBy("pc")).alias("cumulative"))
    last = cum.agg(F.max_by(F.struct("cumulative", "pc"), "pc").alias("r"))
    hit = cum.where(F.col("cumulative") >= threshold).agg(F.min_by(F.struct("cumulative", "pc"), "pc").alias("r"))
    found = F.coalesce(hit.scalar(), F.col("r"))
    return last.select(found.alias("r")).select("r.cumulative", (F.col("r.pc") - 1).alias("index"))


def pc_contribution(table: DataFrame, k: int) -> DataFrame:
    """Share of each feature in the first k components, weighted by eigenvalue."""
    first = table.where(F.col("pc") <= k)
    total = _components(first).agg(F.sum("eigenvalue")).scalar()
    part = F.sum(F.col("loading") * F.col("loading") * F.col("eigenvalue")) / total
    return first.groupBy("feature").agg(part.alias("contribution"))


def ipr(table: DataFrame) -> DataFrame:
    """Inverse participation ratio of each eigenvector."""
    return table.groupBy("pc").agg(F.max("eigenvalue").alias("eigenvalue"), F.sum(F.pow("loading", F.lit(4))).alias("ipr"))


def mp_edges(q: float) -> tuple[float, float]:
    return (1 - math.sqrt(q)) ** 2, (1 + math.sqrt(q)) ** 2


def mp_bounds(matrix: DataFrame, row: str, feature: str) -> DataFrame:
    """Marchenko-Pastur edges of a features / rows ratio."""
    counts = matrix.agg(F.count_distinct(row).alias("n"), F.count_distinct(feature).alias("p"))
    q = F.col("p") / F.col("n")
    return counts.select(
        "n", "p", q.alias("q"), F.pow(1 - F.sqrt(q), F.lit(2)).alias("lambda_min"), F.pow(1 + F.sqrt(q), F.lit(2)).alias("lambda_max")
    )


def _mp(x: Column, q: float | Column, variance: float | Column = 1.0) -> Column:
    q = q if isinstance(q, Column) else F.lit(float(q))
    variance = variance if isinstance(variance, Column) else F.lit(float(variance))
    lo, hi = variance * F.pow(1 - F.sqrt(q), F.lit(2)), variance * F.pow(1 + F.sqrt(q), F.lit(2))
    inside = F.sqrt(F.greatest((hi - x) * (x - lo), F.lit(0.0))) / (2 * math.pi * q * variance * x)
    return F.when((x > lo) & (x < hi), inside).otherwise(0.0)


def mp_density(values: DataFrame, q: float, value: str = "eigenvalue") -> DataFrame:
    """Marchenko-Pastur density at each value, 0 outside the edges."""
    return values.withColumn("density", _mp(F.col(value), q))


def eigen_histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """Density over equal bins from the smallest to the largest value, empty bins included."""
    x = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, n = (ends.select(c).scalar() for c in ("lo", "hi", "n"))
    at = F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = x.groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi", "n").withColumn("bin", F.col("bin").cast("long"))
    full = grid.join(counts, "bin", "left").na.fill(0, ["count"])
    width = (F.col("hi") - F.col("lo")) / bins
    return full.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "count", (F.col("count") / (F.col("n") * width)).alias("density")
    )


def select_components(table: DataFrame, q: float | None = None, mode: str = "upper_lower", ratio: float = 0.0) -> DataFrame:
    """Components outside the noise edges (``upper_lower``), above them (``upper``), with an
    eigenvalue of 1 or more (``unit``), or the first ones that together reach ``ratio``."""
    comps = _components(table)
    if ratio:
        total = comps.agg(F.sum("eigenvalue")).scalar()
        before = F.coalesce(F.sum("eigenvalue").over(Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return comps.withColumn("_b", before / total).where(F.col("_b") < ratio).drop("_b")
    if mode == "unit":
        return comps.where("eigenvalue >= 1")
    lo, hi = mp_edges(q)
    keep = F.col("eigenvalue") >= hi
    return comps.where(keep | (F.col("eigenvalue") <= lo) if mode == "upper_lower" else keep)


# ---- cleaning -------------------------------------------------------------------------------

# Fixed values: (alpha, beta) of the cleaning scenarios.
CLEANING = {"full": (1.0, 1.0), "partial": (0.7, 0.7), "denoise": (1.0, 0.0), "detrend": (0.0, 1.0)}


def rmt_clean(vectors: DataFrame, model: Pca, alpha: float, beta: float, remove: list[int] | None = None, vec: str = "vec") -> DataFrame:
    """Standardised data minus ``beta`` times component 1 and ``alpha`` times each other removed one.

    ``remove`` lists 1-based components; the default is component 1 and those inside the noise edges.
    """
    lo, hi = mp_edges(model.q)
    if remove is None:
        remove = [1] + [i + 1 for i, v in enumerate(model.values) if lo < v < hi and i > 0]
    weight = np.zeros(len(model.values))
    for pc in remove:
        weight[pc - 1] = beta if pc == 1 else alpha
    keep = np.eye(len(weight)) - (model.loadings * weight) @ model.loadings.T
    return _apply(vectors, vec, "cleaned", model.mean, model.scale, keep)


def regression_clean(matrix: DataFrame, scores: DataFrame, row: str = "user_id", feature: str = "feature", value: str = "value") -> DataFrame:
    """Residual of each feature after a linear fit on one score per row."""
    cells = dense(matrix, row, feature, value).join(scores.select(row, "score"), row)
    fit = cells.groupBy(feature).agg(F.regr_slope(value, "score").alias("_b"), F.regr_intercept(value, "score").alias("_a"))
    joined = cells.join(fit, feature)
    return joined.select(row, feature, (F.col(value) - F.col("_a") - F.col("_b") * F.col("score")).alias(value))


@dataclass(frozen=True)
class RmtClassifier:
    """Member test by distance to the span of the significant eigenvectors of a training class."""

    basis: np.ndarray
    epsilon: float

    def residuals(self, vectors: DataFrame, vec: str = "vec") -> DataFrame:
        p = len(self.basis)
        off = np.eye(p) - self.basis @ self.basis.T
        rest = _apply(vectors, vec, "_rest", np.zeros(p), np.ones(p), off)
        norm = F.sqrt(F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x * x))
        return rest.withColumn("residual", norm).drop("_rest")

    def predict(self, vectors: DataFrame, multiple: float = 1.0, vec: str = "vec") -> DataFrame:
        hit = F.col("residual") < self.epsilon * multiple
        return self.residuals(vectors, vec).withColumn("prediction", F.when(hit, 1).otherwise(0).cast("long"))


def rmt_classifier_fit(vectors: DataFrame, threshold_multiple: float = 1.0, train_cutoff: float = 0.95, vec: str = "vec", policy: SkewPolicy = DEFAULT) -> RmtClassifier:
    """Keeps eigenvectors of X'X / n above the upper noise edge; the cutoff is an order statistic."""
    head = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("p")).first()
    n, p = head["n"], head["p"]
    if p > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features: the p x p matrix does not fit the driver")
    values, vecs = _eigh(_gram(vectors, vec, np.zeros(p)) / n)
    edge = mp_edges(p / n)[1] * threshold_multiple
    model = RmtClassifier(vecs[:, values > edge], 0.0)
    ranks = value_ranks(model.residuals(vectors, vec).select("residual"), [], "residual", {"c": F.count(F.lit(1))}, policy)
    at = min(int(train_cutoff * n), n - 1)
    epsilon = ranks.where(F.col("cum_c") > at).agg(F.min("residual")).first()[0]
    return RmtClassifier(model.basis, float(epsilon))


# ---- correlation matrices -------------------------------------------------------------------


def symmetric(pairs: DataFrame, u: str, v: str, value: str, diagonal: float, limit: int = MAX_FEATURES) -> tuple[list, np.ndarray]:
    """Names and full matrix of a small list of pairs u < v; refuses more than ``limit`` names."""
    names = feature_names(pairs.select(F.explode(F.array(u, v)).alias("feature")), "feature", limit)
    at = {n: i for i, n in enumerate(names)}
    out = np.eye(len(names)) * diagonal
    pdf = pairs.select(u, v, value).toPandas()
    i, j = pdf[u].map(at).to_numpy(), pdf[v].map(at).to_numpy()
    out[i, j] = out[j, i] = pdf[value].fillna(0.0).to_numpy()
    return names, out


def _rescaled(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(corr, 1.0)
    return corr


def _pairs(spark, names: list, matrix: np.ndarray, value: str, kind: str) -> DataFrame:
    i, j = np.triu_indices(len(names), 1)
    label = np.array(names, dtype=object)
    pdf = pd.DataFrame({"u": label[i], "v": label[j], value: matrix[i, j]})
    return spark.createDataFrame(pdf, f"u {kind}, v {kind}, {value} double")


def denoise_corr(corr: DataFrame, q: float, detone: bool = False, limit: int = MAX_FEATURES) -> DataFrame:
    """Eigenvalues at or below the upper noise edge are replaced by their mean, then rescaled.

    ``detone`` also removes the first component, the part common to all variables.
    """
    names, rho = symmetric(corr, "u", "v", "rho", 1.0, limit)
    values, vecs = _eigh(rho)
    kept = int((values > mp_edges(q)[1]).sum())
    flat = values.copy()
    if kept < len(flat):
        flat[kept:] = flat[kept:].mean()
    clean = _rescaled((vecs * flat) @ vecs.T)
    if detone:
        values, vecs = _eigh(clean)
        clean = _rescaled(clean - values[0] * np.outer(vecs[:, 0], vecs[:, 0]))
    return _pairs(corr.sparkSession, names, clean, "rho", dict(corr.dtypes)["u"])


def detone_corr(corr: DataFrame, q: float, limit: int = MAX_FEATURES) -> DataFrame:
    return denoise_corr(corr, q, True, limit)


def mp_variance_fit(values: DataFrame, q: float, value: str = "eigenvalue", width: float = 0.25, points: int = 100, grid: int = 99) -> DataFrame:
    """Noise variance whose Marchenko-Pastur density is closest to a Gaussian kernel estimate.

    Variances i / (grid + 1) are compared on ``points`` places between their edges. The
    eigenvalues (at most MAX_FEATURES) are copied to each place and summed.
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k.cast("double"))
    lo, hi = mp_edges(q)
    n = values.agg(F.count(F.lit(1))).scalar()
    copies = values.select(F.col(value).alias("_ev"), F.explode(F.sequence(F.lit(1), F.lit(grid))).alias("_g")).select(
        "_ev", (F.col("_g") / (grid + 1)).alias("variance"), F.explode(places).alias("_k")
    )
    x = F.col("variance") * (lo + (hi - lo) * F.col("_k") / (points - 1))
    z = (F.col("_x") - F.col("_ev")) / width
    kernel = F.exp(-z * z / 2) / (width * math.sqrt(2 * math.pi))
    at = copies.withColumn("_x", x).groupBy("variance", "_k", "_x").agg((F.sum(kernel) / n).alias("_kde"))
    gap = F.col("_kde") - _mp(F.col("_x"), q, F.col("variance"))
    errors = at.groupBy("variance").agg(F.sum(gap * gap).alias("error"))
    best = errors.agg(F.min_by(F.struct("variance", "error"), F.struct("error", "variance")).alias("b"))
    return best.select("b.variance", "b.error", (F.col("b.variance") * hi).alias("lambda_max"))


def corr_distance(corr: DataFrame, kind: str = "half") -> DataFrame:
    """Distance of a correlation: sqrt((1-r)/2) ``half``, sqrt(2(1-r)) ``double`` or ``angular``."""
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho")))
    formula = {"half": F.sqrt(0.5 * (1 - rho)), "double": F.sqrt(2 * (1 - rho)), "angular": F.acos(rho) / math.pi}
    return corr.withColumn("dist", formula[kind])


def pc_sign_vs_result(table: DataFrame, results: DataFrame, pc: int = 1) -> tuple[DataFrame, DataFrame]:
    """Users as variables: sign of their loading against pass / fail; the cells and the test."""
    sign = table.where(F.col("pc") == pc).select(
        F.col("feature").alias("user_id"), F.when(F.col("loading") < 0, 0).otherwise(1).alias("sign")
    )
    both = sign.join(results.select("user_id", "result"), "user_id")
    return contingency(both, "sign", "result"), chi2_contingency(both, "sign", "result")


def pc_group_test(scores: DataFrame, cohorts: DataFrame, pair: tuple, by: tuple[str, ...] = ("pc",)) -> DataFrame:
    """t-test of component scores between two cohorts."""
    return ttest_student(scores.join(cohorts.select("user_id", "cohort"), "user_id"), "cohort", "score", pair, by)
