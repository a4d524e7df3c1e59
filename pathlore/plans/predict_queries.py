from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlore.operators import predict as R
from pathlore.operators import spectral as X
from pathlore.operators.log import shared_columns
from pathlore.plans.registry import big, out, query, rnd
from pathlore.plans.tables import event_log, features, table, uploads, vectors, with_
from pathlore.session import checkpoint_dir


def _data(spark, sf):
    """Embeddings as feature rows: result 1 for labels below 5."""
    return vectors(spark, sf).select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("long").alias("label"), "vec")


def _some(p: int, names=("Logistic Regression", "Decision Tree", "LDA"), trees: int = 10):
    every = R.algorithms(p, trees)
    return {n: every[n] for n in names}


@query(
    "labelled_features",
    with_("uploads")
    + """SELECT v.user_id AS user_id, n, 1 AS result, practice FROM (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1) v
      JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal >= 5000) e USING (user_id)
      JOIN (SELECT user_id, CAST(sum(passed) AS BIGINT) AS practice FROM uploads WHERE task NOT LIKE 'ex%' GROUP BY 1) p USING (user_id)
      UNION ALL SELECT v.user_id, n, 0, practice FROM (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1) v
      JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 1000) e USING (user_id)
      JOIN (SELECT user_id, CAST(sum(passed) AS BIGINT) AS practice FROM uploads WHERE task NOT LIKE 'ex%' GROUP BY 1) p USING (user_id)""",
)
def labelled_features(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    practice = uploads(spark, sf).where("not startswith(task, 'ex')").groupBy("user_id").agg(F.sum("passed").alias("practice"))
    return R.labelled_features(f, c.where("c_acctbal >= 5000"), c.where("c_acctbal < 1000"), practice)


@query("train_eval_all")
def train_eval_all(spark, sf):
    return out(R.train_eval_all(_data(spark, sf), R.algorithms(64))[0])


@query(
    "knn_classify",
    with_(
        "features",
        "ds AS (SELECT a.vec_id AS id, b.vec_id AS near, b.label < 5 AS lb, round(sum((a.value - b.value) * (a.value - b.value)), 12) AS d FROM features a JOIN features b ON a.feature = b.feature WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL)",
        "nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS r FROM ds)",
    )
    + f"SELECT id, {rnd('avg(CAST(lb AS BIGINT))')} AS score FROM nn WHERE r <= 7 GROUP BY id",
)
def knn_classify(spark, sf):
    d = _data(spark, sf)
    return out(R.knn_classify(d.where("id % 5 <> 0"), d.where("id % 5 = 0"), 7).select("id", "score"))


@query("lda_classify")
def lda_classify(spark, sf):
    train, test = R.split(_data(spark, sf))
    return out(R.decision(R.lda_classify(train, test)).drop("vec"))


@query("kernel_svm")
def kernel_svm(spark, sf):
    train, test = R.split(_data(spark, sf))
    return out(R.decision(R.kernel_svm_fit(train)[0](test)).drop("vec"))


@query("adaboost")
def adaboost(spark, sf):
    train, test = R.split(_data(spark, sf))
    return out(R.decision(R.adaboost_fit(train, 10)[0](test)).drop("vec"))


@query("decision", f"SELECT event_id AS id, {rnd('value / 1000')} AS score, CAST(CASE WHEN 1 - value / 1000 >= 0.95 THEN 0 ELSE 1 END AS BIGINT) AS prediction FROM events")
def decision(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 1000).alias("score"))
    return out(R.decision(e, 0.95))


@query("cv10")
def cv10(spark, sf):
    return out(R.cv10(_data(spark, sf), R.algorithms(64)["Logistic Regression"]))


_PRED = """pr AS (SELECT event_type AS algorithm, user_id % 2 AS label, CAST(value > 40 AS BIGINT) AS prediction, value AS score FROM events)"""
_RK = """rk AS (SELECT algorithm, label, rank() OVER (PARTITION BY algorithm ORDER BY score) + (count(*) OVER (PARTITION BY algorithm, score) - 1) / 2.0 AS r FROM pr),
      au AS (SELECT algorithm, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM rk GROUP BY algorithm),
      cf AS (SELECT algorithm, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM pr GROUP BY algorithm)"""


def _predicted(spark, sf):
    e = event_log(spark, sf)
    return e.select(F.col("activity").alias("algorithm"), (F.col("user_id") % 2).alias("label"), (F.col("value") > 40).cast("long").alias("prediction"), F.col("value").alias("score"))


_MET = f"""{rnd('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy, {rnd('2 * tp / (2 * tp + fp + fn)')} AS f1, {rnd('tp / (tp + fp)')} AS precision, {rnd('tp / (tp + fn)')} AS recall,
      {rnd('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS roc_auc, {rnd('auc')} AS auc"""


@query("metrics", with_(_PRED, _RK) + f"SELECT algorithm, tp, fp, tn, fn, {_MET} FROM cf JOIN au USING (algorithm)")
def metrics(spark, sf):
    return out(R.metrics(_predicted(spark, sf), ("algorithm",)))


@query("feature_importance")
def feature_importance(spark, sf):
    _, model = R.algorithms(64, trees=10)["Random Forest"](_data(spark, sf))
    return out(R.feature_importance(model, list(range(64)), spark))


def _weekly(spark, sf):
    """One frame per week: a user's activity counts, result by parity of the user id."""
    acts = ["click", "error", "purchase", "signup", "view"]
    m = event_log(spark, sf).groupBy("week", "user_id").pivot("activity", acts).agg(F.count(F.lit(1))).na.fill(0)
    m = m.select("week", F.col("user_id").alias("id"), (F.col("user_id") % 2).alias("label"), F.array(*[F.col(a).cast("double") for a in acts]).alias("vec"))
    weeks = sorted(r[0] for r in m.select("week").distinct().collect())
    return {w: m.where(F.col("week") == w).drop("week") for w in weeks}


@query("weekly_report")
def weekly_report(spark, sf):
    weeks = _weekly(spark, sf)
    reports = {w: R.train_eval_all(d, _some(5, ("Logistic Regression", "LDA")))[0] for w, d in weeks.items()}
    cv = {(0, "LDA"): R.cv10(weeks[0], _some(5)["LDA"], folds=3)}
    return out(R.weekly_report(reports, cv))


@query(
    "best_algorithm",
    """WITH r AS (SELECT CAST(extract('isodow' FROM ts) AS BIGINT) AS week, 'original' AS scenario, event_type AS algorithm, count(*) / 1000.0 AS f1 FROM events GROUP BY ALL)
      SELECT week, scenario, """ + rnd("max(f1)") + " AS f1, min(algorithm) FILTER (f1 = m) AS algorithm FROM (SELECT *, max(f1) OVER (PARTITION BY week) AS m FROM r) GROUP BY week, scenario",
)
def best_algorithm(spark, sf):
    e = table(spark, sf, "events").select((F.weekday(F.to_date("ts")) + 1).cast("long").alias("week"), F.lit("original").alias("scenario"), F.col("event_type").alias("algorithm"))
    return out(R.best_algorithm(e.groupBy("week", "scenario", "algorithm").agg((F.count(F.lit(1)) / 1000.0).alias("f1"))))


@query("scenarios")
def scenarios(spark, sf):
    d = _data(spark, sf)
    model = X.pca(d)
    ratio = X.np.cumsum(model.values) / model.values.sum()
    k70, k80 = (int((ratio < t).sum()) + 1 for t in (0.7, 0.8))
    sets = {"original": d}
    for name, k in (("pca70", k70), ("pca80", k80)):
        sets[name] = X.pca_scores(d, model, k).select("id", "label", F.col("scores").alias("vec"))
    for name in ("partial", "full"):
        sets[name] = X.rmt_clean(d, model, *X.CLEANING[name]).select("id", "label", F.col("cleaned").alias("vec"))
    report = R.scenarios(sets, lambda p: _some(p, ("Logistic Regression", "LDA")))
    return out(R.scenario_table(report, list(sets)))


@query("cross_year")
def cross_year(spark, sf):
    d = _data(spark, sf)
    return out(R.cross_year(d.where("id % 2 = 0"), d.where("id % 2 = 1"), _some(64)))


@query(
    "cross_year_shared",
    """WITH a AS (SELECT l_suppkey AS user_id, l_partkey % 97 AS feature, count(*) AS value FROM lineitem WHERE year(l_shipdate) <= 1995 GROUP BY ALL),
      b AS (SELECT DISTINCT l_partkey % 97 AS feature FROM lineitem WHERE year(l_shipdate) > 1995) SELECT user_id, feature, value FROM a WHERE feature IN (SELECT feature FROM b)""",
)
def cross_year_shared(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") % 97).alias("feature"), F.year("l_shipdate").alias("y"))
    a = l.where("y <= 1995").groupBy("user_id", "feature").agg(F.count(F.lit(1)).alias("value"))
    return shared_columns(a, l.where("y > 1995")).select("user_id", "feature", "value")


@query(
    "relabel_by_community",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 < 2 THEN 1 WHEN c_custkey % 10 < 4 THEN 0 ELSE CAST(c_acctbal > 4000 AS BIGINT) END AS result FROM customer""",
)
def relabel_by_community(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 4000).cast("long").alias("result"))
    m = F.col("user_id") % 10
    labels = c.select("user_id", F.when(m < 2, "excellent").when(m < 4, "weak").otherwise("mixed").alias("label"))
    return big(R.relabel_by_community(c, labels))


@query("save_load_model")
def save_load_model(spark, sf):
    d = _data(spark, sf)
    _, model = _some(64)["Logistic Regression"](d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/pathlore/model-{uuid.uuid4().hex}"
    R.save_model(model, path)
    from pyspark.ml.functions import array_to_vector

    done = R.load_model(path).transform(d.withColumn("features", array_to_vector("vec")))
    return out(done.select("id", "label", F.col("prediction").cast("long").alias("prediction")))
