from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.functions.cdf import QUANTILE_EDGE, QUANTILE_MIDDLE, QUANTILE_TAIL
from pathlore.operators import stats as T
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, features, table, uploads, with_

# sample: one value per event with a tie-rich integer form, groups = activities
_S = "s AS (SELECT activity AS g, value AS x, CAST(floor(value / 5) AS BIGINT) AS k, user_id % 3 AS h, week FROM log)"


def _sample(spark, sf):
    return event_log(spark, sf).select(
        F.col("activity").alias("g"), F.col("value").alias("x"), F.floor(F.col("value") / 5).alias("k"), (F.col("user_id") % 3).alias("h"), "week"
    )


@query("pearson_p", f"SELECT event_type AS activity, {rnd('corr(value, user_id)')} AS r, count(*) AS n FROM events GROUP BY event_type")
def pearson_p(spark, sf):
    r = T.pearson_p(event_log(spark, sf).withColumn("u", F.col("user_id").cast("double")), "value", "u", ("activity",))
    return out(r.drop("p_value"))


@query(
    "corr_matrix",
    with_("features")
    + f"SELECT a.feature AS u, b.feature AS v, {rnd('corr(a.value, b.value)')} AS rho FROM features a JOIN features b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL",
)
def corr_matrix(spark, sf):
    return out(T.corr_matrix(features(spark, sf), "feature", "vec_id"))


_USERS = """um AS (SELECT user_id, activity AS feature, week, count(*) AS value FROM log GROUP BY ALL)"""


@query(
    "corr_matrix_users",
    with_(
        "log",
        "um AS (SELECT user_id, activity || week AS f, count(*) AS value FROM log GROUP BY ALL)",
        "dense AS (SELECT u.user_id AS user_id, fs.f AS f, coalesce(um.value, 0) AS value FROM (SELECT DISTINCT user_id FROM um) u CROSS JOIN (SELECT DISTINCT f FROM um) fs LEFT JOIN um ON um.user_id = u.user_id AND um.f = fs.f)",
    )
    + f"SELECT a.user_id AS u, b.user_id AS v, {rnd('corr(a.value, b.value)')} AS rho FROM dense a JOIN dense b ON a.f = b.f AND a.user_id < b.user_id GROUP BY ALL",
)
def corr_matrix_users(spark, sf):
    log = event_log(spark, sf)
    um = log.groupBy("user_id", F.concat("activity", F.col("week").cast("string")).alias("f")).agg(F.count(F.lit(1)).alias("value"))
    return out(T.corr_matrix(um, "user_id", "f"))


@query(
    "corr_with_target",
    with_(
        "visits0 AS (SELECT o_custkey AS user_id, l_suppkey % 20 AS feature, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)",
        "dense AS (SELECT u.user_id AS user_id, f.feature AS feature, coalesce(value, 0) AS value FROM (SELECT DISTINCT user_id FROM visits0) u CROSS JOIN (SELECT DISTINCT feature FROM visits0) f LEFT JOIN visits0 v ON v.user_id = u.user_id AND v.feature = f.feature)",
    )
    + f"SELECT feature, {rnd('corr(value, c_acctbal)')} AS r FROM dense JOIN customer ON user_id = c_custkey GROUP BY feature ORDER BY r, feature",
)
def corr_with_target(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    m = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), (F.col("l_suppkey") % 20).alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("target"))
    return out(T.corr_with_target(m, target))


_TWO = """two AS (SELECT week, count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'view') AS n2, avg(x) FILTER (g = 'click') AS mean1, avg(x) FILTER (g = 'view') AS mean2,
      var_samp(x) FILTER (g = 'click') AS v1, var_samp(x) FILTER (g = 'view') AS v2 FROM s GROUP BY week)"""
_TWO_OUT = f"week, n1, n2, {rnd('mean1')} AS mean1, {rnd('mean2')} AS mean2"


@query(
    "ttest_student",
    with_("log", _S, _TWO)
    + f"""SELECT {_TWO_OUT}, {rnd('(mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} AS statistic,
      CAST(n1 + n2 - 2 AS DOUBLE) AS df1 FROM two""",
)
def ttest_student(spark, sf):
    return out(T.ttest_student(_sample(spark, sf), "g", "x", ("click", "view"), ("week",)).drop("p_value"))


@query(
    "ttest_welch",
    with_("log", _S, _TWO)
    + f"""SELECT {_TWO_OUT}, {rnd('(mean1 - mean2) / sqrt(v1 / n1 + v2 / n2)')} AS statistic,
      {rnd('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))')} AS df1 FROM two""",
)
def ttest_welch(spark, sf):
    return out(T.ttest_welch(_sample(spark, sf), "g", "x", ("click", "view"), ("week",)).drop("p_value"))


_MW = """rk AS (SELECT g, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS r FROM s WHERE g IN ('click', 'view'))"""


@query(
    "mann_whitney",
    with_("log", _S, _MW)
    + """SELECT count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'view') AS n2,
      CAST(sum(r) FILTER (g = 'click') - count(*) FILTER (g = 'click') * (count(*) FILTER (g = 'click') + 1) / 2.0 AS DOUBLE) AS statistic FROM rk""",
)
def mann_whitney(spark, sf):
    return T.mann_whitney(_sample(spark, sf), "g", "k", ("click", "view")).drop("p_value")


@query(
    "ks_two_sample",
    with_(
        "log",
        _S,
        "n AS (SELECT week, count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'view') AS n2 FROM s GROUP BY week)",
        """c AS (SELECT week, count(*) FILTER (g = 'click') OVER w AS c1, count(*) FILTER (g = 'view') OVER w AS c2 FROM s
        WINDOW w AS (PARTITION BY week ORDER BY x RANGE UNBOUNDED PRECEDING))""",
    )
    + f"SELECT week, n1, n2, {rnd('max(abs(c1 / n1 - c2 / n2))')} AS statistic FROM c JOIN n USING (week) GROUP BY week, n1, n2",
)
def ks_two_sample(spark, sf):
    return out(T.ks_two_sample(_sample(spark, sf), "g", "x", ("click", "view"), ("week",)).drop("p_value"))


def _f_sql(src: str, g: str, x: str, by: str) -> str:
    return f"""SELECT {by}, {rnd(f'(sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*)))')} AS statistic,
      CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2
      FROM (SELECT {by}, {g}, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS ss FROM {src} GROUP BY ALL)
      JOIN (SELECT {by}, avg({x}) AS gm FROM {src} GROUP BY ALL) USING ({by}) GROUP BY {by}"""


@query("anova_oneway", with_("log", _S) + _f_sql("s", "g", "x", "week"))
def anova_oneway(spark, sf):
    return out(T.anova_oneway(_sample(spark, sf), "g", "x", ("week",)).drop("p_value"))


@query(
    "levene",
    with_(
        "log", _S, "md AS (SELECT week, g, median(x) AS md FROM s GROUP BY ALL)", "dv AS (SELECT week, g, abs(x - md) AS d FROM s JOIN md USING (week, g))"
    )
    + _f_sql("dv", "g", "d", "week"),
)
def levene(spark, sf):
    return out(T.levene(_sample(spark, sf), "g", "x", ("week",)).drop("p_value"))


_RANK = "rk AS (SELECT week, g, k, rank() OVER (PARTITION BY week ORDER BY k) + (count(*) OVER (PARTITION BY week, k) - 1) / 2.0 AS r FROM s)"
_TIES = "ti AS (SELECT week, sum(t * t * t - t) AS t FROM (SELECT week, k, CAST(count(*) AS DOUBLE) AS t FROM s GROUP BY ALL) GROUP BY week)"
_GR = "gr AS (SELECT week, g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS r, sum(r * r) AS rr FROM rk GROUP BY ALL)"
_HH = """hh AS (SELECT week, any_value(ti.t) AS t, sum(n) AS nn, count(*) AS kk, sum(rr) AS rr,
      (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(ti.t) / (pow(sum(n), 3) - sum(n))) AS h FROM gr JOIN ti USING (week) GROUP BY week)"""


@query("kruskal", with_("log", _S, _RANK, _TIES, _GR, _HH) + f"SELECT week, {rnd('h')} AS statistic, CAST(kk - 1 AS DOUBLE) AS df1 FROM hh")
def kruskal(spark, sf):
    return out(T.kruskal(_sample(spark, sf), "g", "k", ("week",)).drop("p_value"))


@query(
    "conover_posthoc",
    with_("log", _S, _RANK, _TIES, _GR, _HH)
    + f"""SELECT week, a.g AS group1, b.g AS group2, CAST(a.n AS BIGINT) AS n1, CAST(b.n AS BIGINT) AS n2,
      {rnd('(a.r / a.n - b.r / b.n) / sqrt((hh.rr - nn * pow(nn + 1, 2) / 4) / (nn - 1) * (nn - 1 - h) / (nn - kk) * (1 / a.n + 1 / b.n))')} AS statistic,
      CAST(nn - kk AS DOUBLE) AS df1 FROM gr a JOIN gr b USING (week) JOIN hh USING (week) WHERE a.g < b.g""",
)
def conover_posthoc(spark, sf):
    return out(T.conover_posthoc(_sample(spark, sf), "g", "k", ("week",)).drop("p_value"))


@query(
    "normaltest",
    with_(
        "log",
        _S,
        "m0 AS (SELECT week, avg(x) AS m FROM s GROUP BY week)",
        "m1 AS (SELECT week, CAST(count(*) AS DOUBLE) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM s JOIN m0 USING (week) GROUP BY week)",
        """m2 AS (SELECT week, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, m4 / (m2 * m2) AS b2s,
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2 FROM m1)""",
        "m3 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2 FROM m2)",
        """m4 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1,
        (b2s - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS xx,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM m3)""",
        "m5 AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS c FROM m4)",
        "m6 AS (SELECT *, ((1 - 2 / (9 * c)) - cbrt((1 - 2 / c) / (1 + xx * sqrt(2 / (c - 4))))) / sqrt(2 / (9 * c)) AS z2 FROM m5)",
    )
    + f"SELECT week, CAST(n AS BIGINT) AS n, {rnd('z1')} AS z_skew, {rnd('z2')} AS z_kurtosis, {rnd('z1 * z1 + z2 * z2')} AS statistic FROM m6",
)
def normaltest(spark, sf):
    return out(T.normaltest(_sample(spark, sf), "x", ("week",)).drop("p_value"))


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


@query(
    "shapiro_wilk",
    with_(
        "log",
        _S,
        "r AS (SELECT week, x - avg(x) OVER (PARTITION BY week) AS d, row_number() OVER (PARTITION BY week ORDER BY x) AS pos, count(*) OVER (PARTITION BY week) AS n FROM s)",
        "p AS (SELECT *, (pos - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r)",
        "q AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS q, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS r FROM p)",
        f"""m AS (SELECT *, CASE WHEN least(p, 1 - p) < {QUANTILE_EDGE} THEN {_poly("q", QUANTILE_TAIL[0])} / {_poly("q", QUANTILE_TAIL[1])} * (CASE WHEN p < 0.5 THEN 1 ELSE -1 END)
        ELSE (p - 0.5::DOUBLE) * {_poly("r", QUANTILE_MIDDLE[0])} / {_poly("r", QUANTILE_MIDDLE[1])} END AS m FROM q)""",
        """a AS (SELECT week, n, 1 / sqrt(n::DOUBLE) AS u, sum(m * m) AS mm, sum(m * d) AS md, sum(d * d) AS ss, max(m) AS m1, max(m) FILTER (pos = n - 1) AS m2,
        max(d) - min(d) AS r1, max(d) FILTER (pos = n - 1) - max(d) FILTER (pos = 2) AS r2 FROM m GROUP BY week, n)""",
        f"b AS (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) ELSE m1 / sqrt(mm) + {_poly('u', T.SW_LAST)} END AS a1, m2 / sqrt(mm) + {_poly('u', T.SW_SECOND)} AS a2 FROM a)",
        """c AS (SELECT *, CASE WHEN n <= 3 THEN a1 * r1 WHEN n <= 5 THEN a1 * r1 + (md - m1 * r1) / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
        ELSE a1 * r1 + a2 * r2 + (md - m1 * r1 - m2 * r2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS t FROM b)""",
    )
    + f"SELECT week, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 AND r1 > 0 THEN {rnd('least(1, t * t / ss)')} END AS statistic FROM c",
)
def shapiro_wilk(spark, sf):
    return out(T.shapiro_wilk(_sample(spark, sf), "x", ("week",)).drop("p_value"))


_CELLS = """ce AS (SELECT ra.a AS a, cb.b AS b, coalesce(n, 0) AS n, r * c / (SELECT count(*) FROM src) AS e
      FROM (SELECT a, CAST(count(*) AS DOUBLE) AS r FROM src GROUP BY a) ra CROSS JOIN (SELECT b, count(*) AS c FROM src GROUP BY b) cb
      LEFT JOIN (SELECT a, b, count(*) AS n FROM src GROUP BY ALL) x ON x.a = ra.a AND x.b = cb.b)"""


@query(
    "chi2_contingency",
    with_("log", "src AS (SELECT week AS a, activity AS b FROM log)", _CELLS)
    + f"SELECT {rnd('sum(pow(n - e, 2) / e)')} AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS df1 FROM ce",
)
def chi2_contingency(spark, sf):
    return out(T.chi2_contingency(event_log(spark, sf), "week", "activity").drop("p_value"))


@query(
    "chi2_yates",
    with_("log", "src AS (SELECT activity = 'click' AS a, value > 40 AS b FROM log)", _CELLS)
    + f"SELECT {rnd('sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e)')} AS statistic, CAST(1 AS DOUBLE) AS df1 FROM ce",
)
def chi2_yates(spark, sf):
    d = event_log(spark, sf).select((F.col("activity") == "click").alias("a"), (F.col("value") > 40).alias("b"))
    return out(T.chi2_contingency(d, "a", "b").drop("p_value"))


@query(
    "contingency_expected",
    "WITH src AS (SELECT l_linestatus AS a, l_partkey % 40 AS b FROM lineitem), " + _CELLS + f" SELECT a, b, n, {rnd('e')} AS expected FROM ce",
)
def contingency_expected(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_partkey") % 40).alias("b"))
    return out(T.contingency(l, "l_linestatus", "b"))


@query(
    "kendall_tau",
    f"""WITH c AS (SELECT l_linenumber AS x, CAST(floor(l_quantity / 5) AS BIGINT) AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
      s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / 2 AS s FROM c a, c b),
      tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y)),
      t AS (SELECT sum(n) AS n FROM c)
      SELECT CAST(n AS BIGINT) AS n, {rnd('s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t))')} AS tau FROM s, tx, ty, t""",
)
def kendall_tau(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linenumber", F.floor(F.col("l_quantity") / 5).alias("q"))
    return out(T.kendall_tau(l, "l_linenumber", "q"))


@query("kurtosis", with_("features") + f"SELECT feature, {rnd('kurtosis_pop(value)')} AS kurtosis FROM features GROUP BY feature")
def kurtosis(spark, sf):
    return out(T.kurtosis(features(spark, sf), "value", ("feature",)))


@query(
    "compare_means",
    with_(
        "features",
        "f AS (SELECT 'Read_Lecture_' || feature AS feature, value, CAST(label < 5 AS BIGINT) AS g FROM features)",
        "rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM f)",
    )
    + f"""SELECT feature, {rnd('avg(value) FILTER (g = 1)')} AS mean1, {rnd('stddev_samp(value) FILTER (g = 1)')} AS sd1, {rnd('avg(value) FILTER (g = 0)')} AS mean2,
      {rnd('stddev_samp(value) FILTER (g = 0)')} AS sd2, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2,
      CAST(sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2.0 AS DOUBLE) AS statistic,
      'Read_Lecture' AS material_type, split_part(feature, '_', 3) AS of_week FROM rk GROUP BY feature""",
)
def compare_means(spark, sf):
    f = features(spark, sf).select(F.concat(F.lit("Read_Lecture_"), F.col("feature").cast("string")).alias("feature"), "value", (F.col("label") < 5).cast("long").alias("g"))
    return out(T.compare_means(f, "g", (1, 0)).drop("p_value"))


# communities for the score table: 2, 4 and 8 groups of customers on three levels
_COMM = """cm AS (SELECT c_custkey AS node, l AS level, c_custkey % CAST(pow(2, l) AS BIGINT) AS community, c_acctbal AS score
      FROM customer, (SELECT unnest([1, 2, 3]) AS l))"""


def _communities(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level"))
    members = c.withColumn("community", F.col("node") % F.pow(F.lit(2), "level").cast("long"))
    return members, table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score"))


@query(
    "community_scores",
    with_(_COMM)
    + f"SELECT CAST(level AS BIGINT) AS level, community, count(*) AS size, {rnd('avg(score)', 5)} AS mean, {rnd('stddev_samp(score)', 5)} AS sd FROM cm GROUP BY level, community",
)
def community_scores(spark, sf):
    from pathlore.plans.registry import big, rounded

    return rounded(big(T.community_scores(*_communities(spark, sf))[0]), 5)


@query(
    "community_tests",
    with_(
        "c8 AS (SELECT level, community, score FROM cm0 WHERE level = 3)".replace("cm0", f"({_COMM[len('cm AS ('):-1]})"),
        "md AS (SELECT community, median(score) AS md FROM c8 GROUP BY ALL)",
        "dv AS (SELECT level, community, abs(score - md) AS d FROM c8 JOIN md USING (community))",
        "rk AS (SELECT community, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM c8)",
        "ti AS (SELECT sum(t * t * t - t) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM c8 GROUP BY score))",
        "gr AS (SELECT community, CAST(count(*) AS DOUBLE) AS n, sum(r) AS r FROM rk GROUP BY ALL)",
    )
    + f"""SELECT CAST(level AS BIGINT) AS level, 'anova' AS test, statistic FROM ({_f_sql('c8', 'community', 'score', 'level')}) UNION ALL
      SELECT CAST(level AS BIGINT), 'levene', statistic FROM ({_f_sql('dv', 'community', 'd', 'level')}) UNION ALL
      SELECT 3, 'kruskal', {rnd('(12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - (SELECT t FROM ti) / (pow(sum(n), 3) - sum(n)))')} FROM gr""",
)
def community_tests(spark, sf):
    return out(T.community_scores(*_communities(spark, sf))[1].drop("p_value"))


@query("bartlett_kmo")
def bartlett_kmo(spark, sf):
    return out(T.bartlett_kmo(features(spark, sf), "feature", "vec_id"))
