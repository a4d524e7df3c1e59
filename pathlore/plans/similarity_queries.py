from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import graph as G
from pathlore.operators import similarity as Y
from pathlore.operators.matrix import activity_matrix, case_to_user, direct_follow
from pathlore.operators.spectral import corr_distance, pca, pca_scores
from pathlore.operators.stats import corr_matrix
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, features, submissions, vectors, with_


def _unit(spark, sf):
    v = vectors(spark, sf)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("_n", norm).withColumn("vec", F.transform("vec", lambda x: x / F.col("_n"))).drop("_n").withColumn("ex", F.col("label") < 5)


@query("kmeans_mixed_rate")
def kmeans_mixed_rate(spark, sf):
    return out(Y.kmeans_mixed_rate(_unit(spark, sf), "ex"))


@query("kmeans_vs_cohort")
def kmeans_vs_cohort(spark, sf):
    v = vectors(spark, sf)
    scored = pca_scores(v, pca(v), 3).withColumn("cohort", F.when(F.col("label") < 5, "excellent").otherwise("weak"))
    return out(Y.kmeans_vs_cohort(scored))


def _tree(spark, sf):
    return G.mst(G.corr_graph(corr_distance(corr_matrix(features(spark, sf), "feature", "vec_id"))))


@query("random_walks")
def random_walks(spark, sf):
    walks = Y.random_walks(_tree(spark, sf), length=8, per_node=15, p=0.1, q=1.0)
    return walks.select("start", F.col("walk").cast("long").alias("walk"), F.posexplode("path").alias("step", "node"))


@query("random_walk_embedding")
def random_walk_embedding(spark, sf):
    found = Y.random_walk_embedding(_tree(spark, sf), dim=16, length=8, per_node=15, p=0.1)
    return out(found.select("node", F.posexplode("vec").alias("dim", "value")))


def _walks(spark, sf):
    log = event_log(spark, sf)
    edges = G.user_graph(case_to_user(direct_follow(log.drop("week"))), activity_matrix(log))[0]
    return Y.random_walks(edges, ["user_id"], length=16, per_node=10)


@query("graph_embedding_sum")
def graph_embedding_sum(spark, sf):
    walks = _walks(spark, sf)
    nodes, _ = Y.walk_embedding(walks, dim=16, window=10)
    return out(Y.graph_embedding_sum(walks, nodes).select("user_id", F.posexplode("vec").alias("dim", "value")))


@query("embedding_2d")
def embedding_2d(spark, sf):
    return out(Y.embedding_2d(vectors(spark, sf))[0])


@query(
    "code_tokens",
    with_("submissions", r"w AS (SELECT task, string_split(rtrim(regexp_replace(upload, '\s+', ' ', 'g')), ' ') AS w FROM submissions)")
    + "SELECT task, len(w[3:]) AS n_tokens, coalesce(array_to_string(w[3:], ' '), '') AS joined FROM w",
)
def code_tokens(spark, sf):
    t = Y.code_tokens(submissions(spark, sf))
    return t.select("task", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("joined"))


@query("code_vectors")
def code_vectors(spark, sf):
    v = Y.code_vectors(Y.code_tokens(submissions(spark, sf)), dim=64)
    return out(v.select("user_id", "task", F.posexplode("vec").alias("dim", "value")))


# user = vec_id mod 50, task = vec_id div 50
_UT = "ut AS (SELECT vec_id % 50 AS user_id, vec_id // 50 AS task, feature, value FROM features)"
_SIM = """sm AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS s
      FROM ut a JOIN ut b ON a.task = b.task AND a.feature = b.feature AND a.user_id <= b.user_id GROUP BY ALL)"""


def _pairs(spark, sf):
    v = vectors(spark, sf)
    return Y.user_code_similarity(v.select((F.col("vec_id") % 50).alias("user_id"), F.floor(F.col("vec_id") / 50).alias("task"), "vec"))


@query("user_code_similarity", with_("features", _UT, _SIM) + f"SELECT u, v, {rnd('s')} AS similarity FROM sm")
def user_code_similarity(spark, sf):
    return out(_pairs(spark, sf))


@query(
    "community_code_similarity",
    with_(
        "features", _UT, _SIM,
        "al AS (SELECT count(*) AS n0, avg(s) AS m0, var_samp(s) AS s0 FROM sm)",
        "gr AS (SELECT u % 6 AS community, count(*) AS n, avg(s) AS m, var_samp(s) AS sv FROM sm WHERE u % 6 = v % 6 GROUP BY ALL)",
    )
    + f"""SELECT community, n, {rnd('m')} AS mean, {rnd('(m0 - m) / sqrt(((n0 - 1) * s0 + (n - 1) * sv) / (n0 + n - 2) * (1.0 / n0 + 1.0 / n))')} AS statistic,
      CAST(n0 + n - 2 AS DOUBLE) AS df1 FROM gr, al""",
)
def community_code_similarity(spark, sf):
    members = vectors(spark, sf).select((F.col("vec_id") % 50).alias("node")).distinct().withColumn("community", F.col("node") % 6)
    return out(Y.community_code_similarity(_pairs(spark, sf), members).drop("p_value"))
