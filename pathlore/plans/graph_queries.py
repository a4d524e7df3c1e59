from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import graph as G
from pathlore.operators.matrix import activity_matrix, case_to_user, direct_follow, steps
from pathlore.operators.score import cohort_fixed4, weekly_mark
from pathlore.operators.spectral import corr_distance
from pathlore.operators.stats import corr_matrix
from pathlore.plans.registry import big, out, query, rnd
from pathlore.plans.tables import event_log, features, table, uploads, with_

ACTS = ["click", "error", "purchase", "signup", "view"]

_MOVES = """nx AS (SELECT user_id, activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log),
      mv AS (SELECT user_id, src, dst, count(*) AS value FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"""
_UG = """ed AS (SELECT user_id, least(src, dst) AS u, greatest(src, dst) AS v, arg_max(value, src) AS w FROM mv GROUP BY 1, 2, 3),
      nd AS (SELECT user_id, node, (SELECT count(*) FROM log l WHERE l.user_id = x.user_id AND l.activity = node) AS weight
      FROM (SELECT user_id, src AS node FROM mv UNION SELECT user_id, dst FROM mv) x)"""


def _moves(spark, sf):
    log = event_log(spark, sf)
    return case_to_user(direct_follow(log.drop("week"))), activity_matrix(log)


@query("user_graph_edges", with_("log", _MOVES, _UG) + "SELECT user_id, u, v, w FROM ed")
def user_graph_edges(spark, sf):
    return G.user_graph(*_moves(spark, sf))[0]


@query("user_graph_nodes", with_("log", _MOVES, _UG) + "SELECT user_id, node, weight FROM nd")
def user_graph_nodes(spark, sf):
    return G.user_graph(*_moves(spark, sf))[1]


@query(
    "graph_features",
    with_(
        "log", _MOVES, _UG,
        "ac AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS a, unnest([0, 1, 2, 3, 4]) AS i)",
        "us AS (SELECT DISTINCT user_id, user_id % 2 AS label FROM ed WHERE user_id % 3 > 0)",
    )
    + """SELECT us.user_id AS user_id, CAST(x.i AS BIGINT) AS i, CAST(y.i AS BIGINT) AS j, CAST(w IS NOT NULL AS BIGINT) AS adjacency,
      coalesce(w, 0) AS edge_weight, coalesce(weight, 0) AS node_weight, label FROM us CROSS JOIN ac x CROSS JOIN ac y
      LEFT JOIN ed ON ed.user_id = us.user_id AND u = least(x.a, y.a) AND v = greatest(x.a, y.a) LEFT JOIN nd ON nd.user_id = us.user_id AND node = x.a""",
)
def graph_features(spark, sf):
    edges, nodes = G.user_graph(*_moves(spark, sf))
    labels = event_log(spark, sf).where("user_id % 3 > 0").select("user_id", (F.col("user_id") % 2).alias("label")).distinct()
    return big(G.graph_features(edges, nodes, labels, ACTS))


_CORR = "cr AS (SELECT a.feature AS u, b.feature AS v, sqrt(0.5 * (1 - corr(a.value, b.value))) AS w FROM features a JOIN features b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL)"


def _distances(spark, sf):
    return G.corr_graph(corr_distance(corr_matrix(features(spark, sf), "feature", "vec_id")))


@query("corr_graph", with_("features", _CORR) + f"SELECT u, v, {rnd('w')} AS w FROM cr")
def corr_graph(spark, sf):
    return out(_distances(spark, sf))


@query("duplicate_weights", with_("features", _CORR) + f"SELECT {rnd('w', 4)} AS w, count(*) AS edges FROM cr GROUP BY 1 HAVING count(*) > 1")
def duplicate_weights(spark, sf):
    d = _distances(spark, sf).withColumn("w", F.round("w", 4) + F.lit(0.0))
    return G.duplicate_weights(d)


@query("mean_weight", with_("features", _CORR) + f"SELECT {rnd('avg(w)')} AS mean_weight, count(*) AS edges FROM cr")
def mean_weight(spark, sf):
    return out(G.mean_weight(_distances(spark, sf)))


@query(
    "mst",
    "WITH RECURSIVE " + with_("features", _CORR)[5:].rstrip()
    + """, pr(nodes, e, k) AS (SELECT [0::BIGINT], NULL::STRUCT(w DOUBLE, u BIGINT, v BIGINT), 1 UNION ALL
      SELECT CASE WHEN list_contains(nodes, n.u) THEN list_append(nodes, n.v) ELSE list_append(nodes, n.u) END, n, k + 1
      FROM (SELECT nodes, k, (SELECT min({'w': w, 'u': u, 'v': v}) FROM cr WHERE list_contains(nodes, u) <> list_contains(nodes, v)) AS n FROM pr WHERE k < 64))
      SELECT e.u AS u, e.v AS v, """ + rnd("e.w") + " AS w FROM pr WHERE k > 1",
)
def mst(spark, sf):
    return out(G.mst(_distances(spark, sf)))


# a tree over the customers: c hangs on c // 3
_TREE = "tr AS (SELECT c_custkey // 3 AS p, c_custkey AS c FROM customer WHERE c_custkey > 0)"


def _tree(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey > 0")
    return c.select(F.floor(F.col("c_custkey") / 3).alias("u"), F.col("c_custkey").alias("v"))


@query(
    "edge_betweenness_tree",
    "WITH RECURSIVE " + with_(_TREE)[5:].rstrip()
    + """, an(a, n) AS (SELECT c, c FROM tr UNION ALL SELECT tr.p, an.n FROM an JOIN tr ON tr.c = an.a WHERE tr.p > 0),
      sz AS (SELECT a, count(*) AS s FROM an GROUP BY a)
      SELECT p AS u, c AS v, s * ((SELECT count(*) + 1 FROM tr) - s) AS betweenness FROM tr JOIN sz ON a = c""",
)
def edge_betweenness_tree(spark, sf):
    return G.edge_betweenness_tree(_tree(spark, sf))


# every cut in turn: (level, node, top of its part) of the tree tr(p, c), whose ancestors are an(a, n)
_CUTS = """an(a, n) AS (SELECT c, c FROM tr UNION ALL SELECT tr.p, an.n FROM an JOIN tr ON tr.c = an.a WHERE tr.p IS NOT NULL),
  cl(level, node, top, parent, community, s, total) AS (SELECT -1::BIGINT, n, min(a), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM an GROUP BY n
    UNION ALL SELECT x.level + 1, x.node, CASE WHEN d.n IS NOT NULL AND x.top = b.e.top THEN b.e.node ELSE x.top END, b.e.top, b.e.node, b.e.s, b.e.total
    FROM cl x CROSS JOIN (SELECT min({'b': s * (s - total), 'node': node, 'top': top, 's': s, 'total': total}) AS e FROM (
      SELECT i.node AS node, i.top AS top, count(*) AS s, any_value(t.total) AS total FROM cl i JOIN an ON an.a = i.node JOIN cl j ON j.node = an.n AND j.top = i.top
      JOIN (SELECT top, count(*) AS total FROM cl GROUP BY top) t ON t.top = i.top WHERE i.node <> i.top GROUP BY ALL)) b LEFT JOIN an d ON d.a = b.e.node AND d.n = x.node WHERE b.e IS NOT NULL)"""


@query(
    "girvan_newman_tree",
    "WITH RECURSIVE tr AS (SELECT c_custkey // 3 AS p, c_custkey AS c FROM customer WHERE c_custkey > 0 UNION ALL SELECT NULL, 0), " + _CUTS
    + " SELECT node, top AS community, min(level) AS first_level, max(level) AS last_level FROM cl GROUP BY node, top",
)
def girvan_newman_tree(spark, sf):
    return G.tree_splits(_tree(spark, sf))[1]


@query(
    "split_hierarchy",
    "WITH RECURSIVE " + with_("features", _CORR)[5:].rstrip()
    + """, pr(nodes, p, c, k) AS (SELECT [0::BIGINT], NULL::BIGINT, NULL::BIGINT, 1 UNION ALL
      SELECT list_append(nodes, o.c), o.p, o.c, k + 1 FROM (SELECT nodes, k, CASE WHEN list_contains(nodes, n.u) THEN {'p': n.u, 'c': n.v} ELSE {'p': n.v, 'c': n.u} END AS o
      FROM (SELECT nodes, k, (SELECT min({'w': w, 'u': u, 'v': v}) FROM cr WHERE list_contains(nodes, u) <> list_contains(nodes, v)) AS n FROM pr WHERE k < 64))),
      tr AS (SELECT p, c FROM pr WHERE k > 1 UNION ALL SELECT NULL, 0), """
    + _CUTS
    + " SELECT DISTINCT level, parent, community, -(s * (s - total)) AS betweenness, total - s AS kept_size, s AS split_size FROM cl WHERE level >= 0",
)
def split_hierarchy(spark, sf):
    return G.tree_splits(G.mst(_distances(spark, sf)))[0]


_MEM = """mb AS (SELECT c_custkey AS node, CAST(l AS BIGINT) AS level, c_custkey % CAST(pow(2, l) AS BIGINT) AS community, c_acctbal > 5000 AND c_custkey % 5 <> 1 AS ex
      FROM customer, (SELECT unnest([1, 2, 3, 4]) AS l))"""


def _members(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("level"))
    members = c.select("node", F.col("level").cast("long").alias("level"), (F.col("node") % F.pow(F.lit(2), "level").cast("long")).alias("community"))
    excellent = table(spark, sf, "customer").where("c_acctbal > 5000 and c_custkey % 5 <> 1").select(F.col("c_custkey").alias("user_id"))
    return members, excellent


@query("community_flatten", "SELECT c_custkey AS node, c_nationkey AS community FROM customer")
def community_flatten(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("community"))
    return G.community_flatten(G.community_regroup(c))


@query("community_purity", with_(_MEM) + f"SELECT level, community, count(*) AS size, {rnd('avg(CAST(ex AS BIGINT))')} AS excellent_rate FROM mb GROUP BY level, community")
def community_purity(spark, sf):
    return out(G.community_purity(*_members(spark, sf)))


@query("user_purity_by_level", with_(_MEM) + f"SELECT node, level, {rnd('avg(CAST(ex AS BIGINT)) OVER (PARTITION BY level, community)')} AS excellent_rate FROM mb")
def user_purity_by_level(spark, sf):
    return out(G.user_purity_by_level(*_members(spark, sf)))


@query(
    "label_community",
    with_(_MEM, "pu AS (SELECT level, community, avg(CAST(ex AS BIGINT)) AS r FROM mb GROUP BY ALL)")
    + "SELECT level, community, CASE WHEN r >= 0.7 THEN 'excellent' WHEN r <= 0.3 THEN 'weak' ELSE 'mixed' END AS label FROM pu",
)
def label_community(spark, sf):
    return G.label_community(G.community_purity(*_members(spark, sf))).select("level", "community", "label")


@query(
    "mixed_rate_curve",
    with_(_MEM, "pu AS (SELECT level, community, avg(CAST(ex AS BIGINT)) AS r FROM mb GROUP BY ALL)")
    + f"""SELECT level, count(*) FILTER (r >= 0.65) AS excellent, count(*) FILTER (r < 0.35) AS weak, count(*) FILTER (r >= 0.35 AND r < 0.65) AS mixed,
      {rnd('count(*) FILTER (r >= 0.35 AND r < 0.65) / count(*)')} AS mixed_share FROM pu GROUP BY level""",
)
def mixed_rate_curve(spark, sf):
    return out(G.mixed_rate_curve(G.community_purity(*_members(spark, sf))))


_LAB = """wk AS (SELECT CAST(dayofyear(date) % 13 AS BIGINT) AS week, user_id, CASE WHEN sum(passed) / (sum(passed) + sum(failed)) >= 0.7 THEN 'excellent'
      WHEN sum(passed) / (sum(passed) + sum(failed)) >= 0.6 THEN 'good' WHEN sum(passed) / (sum(passed) + sum(failed)) >= 0.5 THEN 'medium' ELSE 'bad' END AS label FROM uploads GROUP BY ALL),
      rs AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN 'passed' ELSE 'failed' END AS result FROM customer)"""


def _labels(spark, sf):
    u = uploads(spark, sf).withColumn("week", (F.dayofyear("date") % 13).cast("long"))
    return cohort_fixed4(weekly_mark(u)).select("week", "user_id", F.col("cohort").alias("label"))


@query(
    "cohort_movement",
    with_("uploads", _LAB)
    + """SELECT a.week AS week, a.label AS source, b.label AS target, count(*) AS n FROM wk a JOIN wk b ON a.user_id = b.user_id AND b.week = a.week + 1 GROUP BY ALL
      UNION ALL SELECT week, label, result, count(*) FROM wk JOIN rs USING (user_id) WHERE week = (SELECT max(week) FROM wk) GROUP BY ALL""",
)
def cohort_movement(spark, sf):
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, "passed").otherwise("failed").alias("result"))
    return G.cohort_movement(_labels(spark, sf), r)


@query(
    "label_grid",
    with_("uploads", _LAB)
    + """SELECT u.user_id AS user_id, w AS week, coalesce(label, '-1') AS label FROM (SELECT DISTINCT user_id FROM wk) u CROSS JOIN (SELECT unnest(range(13)) AS w)
      LEFT JOIN wk ON wk.user_id = u.user_id AND wk.week = w""",
)
def label_grid(spark, sf):
    return G.label_grid(_labels(spark, sf), 13)


# suppliers and part groups joined by their line items
_SP = "eg AS (SELECT l_suppkey AS u, 100000 + l_partkey % 100 AS v, count(*) AS w FROM lineitem GROUP BY ALL)"
_SPN = "nn AS (SELECT DISTINCT n AS node, n % 7 AS community FROM (SELECT u AS n FROM eg UNION ALL SELECT v FROM eg))"


def _bipartite(spark, sf):
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("u"), (100000 + F.col("l_partkey") % 100).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return edges, nodes.withColumn("community", F.col("node") % 7)


@query(
    "modularity",
    with_(
        _SP, _SPN,
        "dg AS (SELECT c, sum(d) AS d FROM (SELECT community AS c, sum(w) AS d FROM eg JOIN nn ON node = u GROUP BY 1 UNION ALL SELECT community, sum(w) FROM eg JOIN nn ON node = v GROUP BY 1) GROUP BY c)",
        "m AS (SELECT sum(w) AS m FROM eg)",
        "i AS (SELECT sum(w) AS s FROM eg JOIN nn a ON a.node = u JOIN nn b ON b.node = v WHERE a.community = b.community)",
    )
    + f"SELECT {rnd('(SELECT s FROM i) / (SELECT m FROM m) - (SELECT sum(pow(d, 2)) FROM dg) / pow(2 * (SELECT m FROM m), 2)')} AS q",
)
def modularity(spark, sf):
    return out(G.modularity(*_bipartite(spark, sf)))


@query(
    "center_nodes",
    with_(
        _SP, _SPN,
        "dg AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM eg UNION ALL SELECT v FROM eg) GROUP BY n)",
        "rk AS (SELECT community, node, d, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY d DESC, node) AS r FROM nn JOIN dg ON n = node)",
    )
    + f"SELECT community, node, d AS degree, {rnd('d / size')} AS degree_share FROM rk WHERE r = 1",
)
def center_nodes(spark, sf):
    return out(G.center_nodes(*_bipartite(spark, sf)))


_WC = "wc AS (SELECT week, user_id AS node, count(*) % 4 AS community FROM log GROUP BY week, user_id)"


def _weekly_members(spark, sf):
    return event_log(spark, sf).groupBy("week", F.col("user_id").alias("node")).agg((F.count(F.lit(1)) % 4).alias("community"))


@query(
    "super_graph",
    with_(
        "log", _WC,
        "pr AS (SELECT a.week AS week, a.node AS u, b.node AS v FROM wc a JOIN wc b ON a.week = b.week AND a.community = b.community AND a.node < b.node)",
        "il AS (SELECT *, week - row_number() OVER (PARTITION BY u, v ORDER BY week) AS g FROM pr)",
        "bo AS (SELECT u, v, week + 1 + row_number() OVER (PARTITION BY u, v, g ORDER BY week) - 1 AS w FROM il)",
    )
    + "SELECT u, v, CAST(sum(w) AS DOUBLE) AS w FROM bo GROUP BY u, v",
)
def super_graph(spark, sf):
    return G.super_graph(_weekly_members(spark, sf), [1, 2, 3, 4, 5])


@query("super_graph_tree")
def super_graph_tree(spark, sf):
    return out(G.super_graph_tree(_weekly_members(spark, sf), [1, 2, 3, 4, 5]))


@query(
    "partition_agreement",
    f"""WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 4 AS b, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
      ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
      h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, t) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hab,
        (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, t * (t - 1) / 2 AS st FROM t),
      m AS (SELECT (ha + hb - hab) / ha AS h, (ha + hb - hab) / hb AS c, (s - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st) AS ari FROM h)
      SELECT {rnd('h')} AS homogeneity, {rnd('c')} AS completeness, {rnd('2 * h * c / (h + c)')} AS v_measure, {rnd('ari')} AS adjusted_rand FROM m""",
)
def partition_agreement(spark, sf):
    c = table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("community"))
    b = c.select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 4).alias("community"))
    return out(G.partition_agreement(a, b))


@query("community_detect")
def community_detect(spark, sf):
    return G.community_detect(_bipartite(spark, sf)[0])


@query("community_detect_per_user")
def community_detect_per_user(spark, sf):
    edges = G.user_graph(*_moves(spark, sf))[0]
    return G.community_detect(edges, ["user_id"])


def _user_edges(spark, sf):
    """Activities of a user as nodes, linked if they follow each other at least twice on a day."""
    pairs = steps(event_log(spark, sf)).where("src <> dst").groupBy(F.col("user_id").alias("graph"), F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return pairs.agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("graph", "u", "v")


# shortest paths of up to four edges: the graphs have five nodes
_PATHS = """nx AS (SELECT user_id AS graph, activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS b FROM log),
  e AS (SELECT graph, least(a, b) AS u, greatest(a, b) AS v FROM nx WHERE b IS NOT NULL AND a <> b GROUP BY ALL HAVING count(*) >= 2),
  ar AS (SELECT graph, u AS a, v AS b FROM e UNION ALL SELECT graph, v, u FROM e),
  pt(graph, s, t, way) AS (SELECT graph, a, b, [a, b] FROM ar UNION ALL SELECT pt.graph, s, b, list_append(way, b) FROM pt JOIN ar ON ar.graph = pt.graph AND ar.a = pt.t AND NOT list_contains(way, b)),
  sp AS (SELECT * FROM pt QUALIFY len(way) = min(len(way)) OVER (PARTITION BY graph, s, t)),
  wt AS (SELECT graph, way, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph, s, t) AS w FROM sp WHERE s < t),
  on_ AS (SELECT graph, w, unnest(list_transform(range(1, len(way)), lambda i: {'u': least(way[i], way[i + 1]), 'v': greatest(way[i], way[i + 1])})) AS p FROM wt)"""


@query("edge_betweenness", "WITH RECURSIVE " + with_("log", _PATHS)[5:] + f"SELECT graph, p.u AS u, p.v AS v, {rnd('sum(w)')} AS betweenness FROM on_ GROUP BY ALL")
def edge_betweenness(spark, sf):
    return out(G.edge_betweenness(_user_edges(spark, sf)))


@query("girvan_newman")
def girvan_newman(spark, sf):
    return G.girvan_newman(_user_edges(spark, sf))
