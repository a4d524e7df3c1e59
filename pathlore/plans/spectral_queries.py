from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import spectral as X
from pathlore.operators.process import EDGE, edges_from_contribution
from pathlore.operators.matrix import direct_follow, case_to_user
from pathlore.operators.stats import corr_matrix
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, features, vectors, with_
from pathlore.session import cut_lineage

_UM = "um AS (SELECT week, user_id, activity AS feature, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY ALL)"
_DENSE = """dn AS (SELECT r.week AS week, r.user_id AS user_id, f.feature AS feature, coalesce(um.value, 0) AS value FROM (SELECT DISTINCT week, user_id FROM um) r
      JOIN (SELECT DISTINCT week, feature FROM um) f ON r.week = f.week LEFT JOIN um ON um.week = r.week AND um.user_id = r.user_id AND um.feature = f.feature)"""


def _weekly(spark, sf):
    return event_log(spark, sf).groupBy("week", "user_id", F.col("activity").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _user_moves(spark, sf):
    """user x transition counts, the matrix the cleaning is meant for."""
    m = case_to_user(direct_follow(event_log(spark, sf).drop("week")))
    return m.select("user_id", F.concat_ws(EDGE, "src", "dst").alias("feature"), F.col("value").cast("double").alias("value"))


def _user_vectors(spark, sf):
    """The matrix as vectors, written once because a decomposition reads them several times."""
    m = _user_moves(spark, sf)
    names = X.feature_names(m)
    return names, cut_lineage(X.to_vectors(m, names))


@query(
    "standardise",
    with_("log", _UM, _DENSE)
    + f"""SELECT week, user_id, feature, {rnd('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END')} AS value
      FROM dn WINDOW w AS (PARTITION BY week, feature)""",
)
def standardise(spark, sf):
    return out(X.standardise(_weekly(spark, sf), by=("week",)))


@query(
    "minmax",
    with_("log", _UM, _DENSE)
    + f"""SELECT week, user_id, feature, {rnd('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END')} AS value
      FROM dn WINDOW w AS (PARTITION BY week, feature)""",
)
def minmax(spark, sf):
    return out(X.minmax(_weekly(spark, sf), by=("week",)))


@query("l2_normalise", with_("log", _UM) + f"SELECT week, user_id, feature, {rnd('value / sqrt(sum(value * value) OVER (PARTITION BY week, user_id))')} AS value FROM um")
def l2_normalise(spark, sf):
    return out(X.l2_normalise(_weekly(spark, sf), by=("week",)))


@query("pca_loadings")
def pca_loadings(spark, sf):
    return out(X.pca(vectors(spark, sf)).table(spark))


@query("pca_scores")
def pca_scores(spark, sf):
    v = vectors(spark, sf)
    return out(X.scores_long(X.pca_scores(v, X.pca(v), 8), "vec_id"))


@query("pca_scores_raw")
def pca_scores_raw(spark, sf):
    v = vectors(spark, sf)
    return out(X.scores_long(X.pca_scores(v, X.pca(v, scaled=False), 8), "vec_id"))


# the vectors read as a table of loadings with falling eigenvalues
_TABLE = """tb AS (SELECT vec_id + 1 AS pc, 100.0 / (vec_id + 1) AS eigenvalue, feature, value AS loading FROM features),
      ev AS (SELECT DISTINCT pc, CAST(eigenvalue AS DOUBLE) AS eigenvalue FROM tb)"""


def _table(spark, sf):
    f = features(spark, sf)
    t = f.select((F.col("vec_id") + 1).alias("pc"), (100.0 / (F.col("vec_id") + 1)).alias("eigenvalue"), "feature", F.col("value").alias("loading"))
    total = t.select("pc", "eigenvalue").distinct().agg(F.sum("eigenvalue")).scalar()
    return t.withColumn("ratio", F.col("eigenvalue") / total)


@query(
    "num_pcs",
    with_("features", _TABLE, "cu AS (SELECT pc, sum(eigenvalue) OVER (ORDER BY pc) / (SELECT sum(eigenvalue) FROM ev) AS c FROM ev)")
    + f"SELECT {rnd('c')} AS cumulative, pc - 1 AS index FROM cu WHERE c >= 0.7 ORDER BY pc LIMIT 1",
)
def num_pcs(spark, sf):
    return out(X.num_pcs(_table(spark, sf), 0.7))


@query(
    "pc_contribution",
    with_("features", _TABLE) + f"SELECT feature, {rnd('sum(loading * loading * eigenvalue) / (SELECT sum(eigenvalue) FROM ev WHERE pc <= 10)')} AS contribution FROM tb WHERE pc <= 10 GROUP BY feature",
)
def pc_contribution(spark, sf):
    return out(X.pc_contribution(_table(spark, sf), 10))


@query("ipr", with_("features", _TABLE) + f"SELECT pc, {rnd('max(eigenvalue)')} AS eigenvalue, {rnd('sum(pow(loading, 4))')} AS ipr FROM tb GROUP BY pc")
def ipr(spark, sf):
    return out(X.ipr(_table(spark, sf)))


@query(
    "mp_bounds",
    with_("features", "c AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT feature) AS p FROM features)")
    + f"SELECT n, p, {rnd('p / n')} AS q, {rnd('pow(1 - sqrt(p / n), 2)')} AS lambda_min, {rnd('pow(1 + sqrt(p / n), 2)')} AS lambda_max FROM c",
)
def mp_bounds(spark, sf):
    return out(X.mp_bounds(features(spark, sf), "vec_id", "feature"))


def _mp_sql(x: str, q: str, v: str = "1.0") -> str:
    lo, hi = f"({v} * pow(1 - sqrt({q}), 2))", f"({v} * pow(1 + sqrt({q}), 2))"
    return f"CASE WHEN {x} > {lo} AND {x} < {hi} THEN sqrt(greatest(({hi} - {x}) * ({x} - {lo}), 0)) / (2 * pi() * {q} * {v} * {x}) ELSE 0 END"


@query("mp_density", f"SELECT event_id, {rnd(_mp_sql('(value / 20)', '0.25'))} AS density FROM events")
def mp_density(spark, sf):
    e = event_log(spark, sf).select("event_id", (F.col("value") / 20).alias("eigenvalue"))
    return out(X.mp_density(e, 0.25).select("event_id", "density"))


@query(
    "eigen_histogram",
    with_(
        "features",
        "e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM features)",
        "c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS c FROM features, e GROUP BY 1)",
    )
    + f"""SELECT b AS bin, {rnd('lo + b * (hi - lo) / 50')} AS left_edge, coalesce(c, 0) AS count, {rnd('coalesce(c, 0) / (n * (hi - lo) / 50)')} AS density
      FROM (SELECT unnest(range(50)) AS b) g CROSS JOIN e LEFT JOIN c ON c.bin = b""",
)
def eigen_histogram(spark, sf):
    return out(X.eigen_histogram(features(spark, sf), "value", 50))


for _name, _args, _where in (
    ("upper", {"q": 0.5, "mode": "upper"}, "eigenvalue >= pow(1 + sqrt(0.5), 2)"),
    ("upper_lower", {"q": 0.02, "mode": "upper_lower"}, "(eigenvalue >= pow(1 + sqrt(0.02), 2) OR eigenvalue <= pow(1 - sqrt(0.02), 2))"),
    ("unit", {"mode": "unit"}, "eigenvalue >= 1"),
):

    @query(f"select_components_{_name}", with_("features", _TABLE) + f"SELECT pc, {rnd('eigenvalue')} AS eigenvalue FROM ev WHERE {_where}")
    def select_components(spark, sf, args=_args):
        return out(X.select_components(_table(spark, sf).withColumn("eigenvalue", F.col("eigenvalue") * 1.0), **args))


@query(
    "select_components_ratio",
    with_("features", _TABLE, "cu AS (SELECT pc, eigenvalue, (sum(eigenvalue) OVER (ORDER BY pc) - eigenvalue) / (SELECT sum(eigenvalue) FROM ev) AS b FROM ev)")
    + f"SELECT pc, {rnd('eigenvalue')} AS eigenvalue FROM cu WHERE b < 0.8",
)
def select_components_ratio(spark, sf):
    return out(X.select_components(_table(spark, sf), ratio=0.8))


for _kind, (_alpha, _beta) in X.CLEANING.items():

    @query(f"rmt_clean_{_kind}")
    def rmt_clean(spark, sf, alpha=_alpha, beta=_beta):
        names, v = _user_vectors(spark, sf)
        cleaned = X.rmt_clean(v, X.pca(v, names), alpha, beta)
        return out(X.to_long(cleaned, names, vec="cleaned"))


@query(
    "regression_clean",
    with_("features", "sc AS (SELECT vec_id, value AS score FROM features WHERE feature = 0)", "ft AS (SELECT feature, regr_slope(value, score) AS b, regr_intercept(value, score) AS a FROM features JOIN sc USING (vec_id) GROUP BY feature)")
    + f"SELECT vec_id, feature, {rnd('value - a - b * score')} AS value FROM features JOIN sc USING (vec_id) JOIN ft USING (feature)",
)
def regression_clean(spark, sf):
    f = features(spark, sf)
    score = f.where("feature = 0").select("vec_id", F.col("value").alias("score"))
    return out(X.regression_clean(f, score, "vec_id"))


@query("rmt_classifier")
def rmt_classifier(spark, sf):
    v = vectors(spark, sf)
    sums = X.pca(v)
    z = X._apply(v, "vec", "z", sums.mean, sums.scale, X.np.eye(len(sums.mean)))
    model = X.rmt_classifier_fit(z.where("label < 5"), vec="z")
    return out(model.predict(z, vec="z").select("vec_id", "label", "residual", "prediction"))


def _corr(spark, sf):
    return corr_matrix(features(spark, sf), "feature", "vec_id")


@query("denoise_corr")
def denoise_corr(spark, sf):
    n = vectors(spark, sf).count()
    return out(X.denoise_corr(_corr(spark, sf), 64 / n))


@query("detone_corr")
def detone_corr(spark, sf):
    n = vectors(spark, sf).count()
    return out(X.detone_corr(_corr(spark, sf), 64 / n))


_EVALS = "evs AS (SELECT feature, var_pop(value) * 40 AS ev FROM features GROUP BY feature)"


@query(
    "mp_variance_fit",
    with_(
        "features",
        _EVALS,
        "gr AS (SELECT g / 100.0 AS v, k FROM (SELECT unnest(range(1, 100)) AS g) CROSS JOIN (SELECT unnest(range(100)) AS k))",
        "pt AS (SELECT v, k, v * (pow(1 - sqrt(0.2), 2) + (pow(1 + sqrt(0.2), 2) - pow(1 - sqrt(0.2), 2)) * k / 99.0) AS x FROM gr)",
        "kd AS (SELECT v, k, x, sum(exp(-pow((x - ev) / 0.25, 2) / 2) / (0.25 * sqrt(2 * pi()))) / (SELECT count(*) FROM evs) AS kde FROM pt, evs GROUP BY ALL)",
        f"er AS (SELECT CAST(v AS DOUBLE) AS variance, sum(pow(kde - {_mp_sql('x', '0.2', 'v')}, 2)) AS error FROM kd GROUP BY v)",
    )
    + f"SELECT {rnd('variance')} AS variance, {rnd('error', 5)} AS error, {rnd('variance * pow(1 + sqrt(0.2), 2)')} AS lambda_max FROM er ORDER BY error, variance LIMIT 1",
)
def mp_variance_fit(spark, sf):
    ev = features(spark, sf).groupBy("feature").agg((F.var_pop("value") * 40).alias("eigenvalue"))
    fit = X.mp_variance_fit(ev, 0.2)
    return out(fit.withColumn("error", F.round("error", 5)))


@query(
    "corr_distance",
    with_("features", "r AS (SELECT a.feature AS u, b.feature AS v, corr(a.value, b.value) AS rho FROM features a JOIN features b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL)")
    + f"SELECT u, v, {rnd('sqrt(0.5 * (1 - rho))')} AS half, {rnd('sqrt(2 * (1 - rho))')} AS double, {rnd('acos(rho) / pi()')} AS angular FROM r",
)
def corr_distance(spark, sf):
    d = _corr(spark, sf)
    for kind in ("half", "double", "angular"):
        d = X.corr_distance(d, kind).withColumnRenamed("dist", kind)
    return out(d.drop("rho"))


def _result(m):
    return m.select("user_id").distinct().withColumn("result", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))


@query("pc_sign_vs_result")
def pc_sign_vs_result(spark, sf):
    m = cut_lineage(_user_moves(spark, sf))
    return out(X.pc_sign_vs_result(X.variables_pca(m, 2), _result(m), 2)[0])


@query("pc_group_test")
def pc_group_test(spark, sf):
    names, v = _user_vectors(spark, sf)
    scores = X.scores_long(X.pca_scores(v, X.pca(v, names), 4))
    return out(X.pc_group_test(scores, _result(v).withColumnRenamed("result", "cohort"), (1, 0)))


@query("edges_from_contribution")
def edges(spark, sf):
    names, v = _user_vectors(spark, sf)
    table = X.pca(v, names).table(spark)
    return out(edges_from_contribution(X.pc_contribution(table, 5), 10))
