from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import log as L
from pathlore.plans.registry import big, out, query, rnd
from pathlore.plans.tables import described_log, event_log, features, material, table, uploads, visits, with_


@query("case_key", with_("log") + "SELECT event_id, case_id FROM log")
def case_key(spark, sf):
    return L.case_key(table(spark, sf, "events")).select("event_id", "case_id")


@query(
    "case_key_session",
    "SELECT event_id, concat_ws('-', CAST(CAST(ts AS DATE) AS VARCHAR), CAST(user_id AS VARCHAR), event_type) AS case_id FROM events",
)
def case_key_session(spark, sf):
    return L.case_key(table(spark, sf, "events"), session="event_type").select("event_id", "case_id")


@query(
    "filter_regex",
    with_("described") + "SELECT page_id, description FROM described WHERE regexp_matches(description, '.html|.py|#|/einstein/')",
)
def filter_regex(spark, sf):
    return L.filter_regex(described_log(spark, sf), [".html", ".py", "#", "/einstein/"])


@query(
    "page_name",
    with_("described")
    + r"""SELECT page_id, CASE WHEN regexp_matches(description, 'correct|incorrect|^/einstein/') THEN 'Practice'
      WHEN regexp_extract(description, '([^\/][\S]+.html)', 1) <> ''
      THEN regexp_replace(regexp_extract(description, '([^\/][\S]+.html)', 1), '.web', '', 'g')
      ELSE 'General' END AS page_name FROM described""",
)
def page_name(spark, sf):
    return L.page_name(described_log(spark, sf)).select("page_id", "page_name")


@query(
    "page_type_rules",
    with_("described")
    + """SELECT page_id, page_type FROM (SELECT page_id, CASE
      WHEN regexp_matches(description, 'http|report|dashboard|graphs.html') THEN 'Admin_page'
      WHEN regexp_matches(description, 'solution') THEN 'Check_solution'
      WHEN regexp_matches(description, 'labsheet|instructions') THEN 'Read_Labsheet'
      WHEN regexp_matches(description, 'correct|incorrect') THEN 'Exercise'
      WHEN regexp_matches(description, '.html|.web') THEN 'Read_Lecture_Note' END AS page_type FROM described)
      WHERE page_type IS NOT NULL""",
)
def page_type_rules(spark, sf):
    return L.page_type_rules(described_log(spark, sf)).select("page_id", "page_type")


@query("drop_actions", with_("log") + "SELECT event_id, activity FROM log WHERE activity NOT IN ('click', 'error')")
def drop_actions(spark, sf):
    return L.drop_actions(event_log(spark, sf), ("click", "error")).select("event_id", "activity")


@query(
    "lecture_list",
    with_("described", "heads AS (SELECT trim(split_part(description, ' ', 1)) AS h FROM described WHERE regexp_matches(description, 'html'))")
    + "SELECT DISTINCT trim(split_part(h, '#', 1)) AS page FROM heads WHERE h <> '/' AND trim(split_part(h, '#', 1)) <> '/'",
)
def lecture_list(spark, sf):
    return L.lecture_list(described_log(spark, sf))


@query(
    "lecture_list_excluding",
    with_(
        "described",
        """heads AS (SELECT trim(split_part(description, ' ', 1)) AS h FROM described
        WHERE regexp_matches(description, 'html') AND NOT regexp_matches(description,
        'http|report.html|index.html|dashboard|graphs.html|sick|log.html'))""",
    )
    + "SELECT DISTINCT trim(split_part(h, '#', 1)) AS page FROM heads WHERE h <> '/' AND trim(split_part(h, '#', 1)) <> '/'",
)
def lecture_list_excluding(spark, sf):
    return L.lecture_list(described_log(spark, sf), exclude=L.LECTURE_EXCLUDED)


@query(
    "concept_page",
    with_("described")
    + """SELECT page_id, CASE WHEN contains(description, '#') THEN split_part(description, '#', 1)
      ELSE split_part(description, ' ', 1) END AS page FROM described""",
)
def concept_page(spark, sf):
    return L.concept_page(described_log(spark, sf)).select("page_id", "page")


_LABELLED = """labelled AS (SELECT user_id, page_type || '_' || CASE WHEN page_type = 'PROMO' THEN week ELSE of_week END AS page_type_week,
      activity FROM visits JOIN material USING (page))"""


@query(
    "context_label",
    with_("visits", "material", _LABELLED)
    + """SELECT user_id, page_type_week, page_type_week || '*' || activity AS context, count(*) AS n
      FROM labelled GROUP BY ALL""",
)
def context_label(spark, sf):
    joined = L.join_material(visits(spark, sf), material(spark, sf))
    labelled = L.context_label(joined, practice="PROMO")
    return labelled.groupBy("user_id", "page_type_week", "context").agg(F.count(F.lit(1)).alias("n"))


_MAP = "ids AS (SELECT user_id, 's' || (row_number() OVER (ORDER BY user_id) - 1) AS label FROM (SELECT DISTINCT user_id FROM events))"


@query("relabel_ids", with_(_MAP) + "SELECT user_id, label FROM ids")
def relabel_ids(spark, sf):
    return L.relabel_ids(table(spark, sf, "events"))


@query("reverse_relabel", with_(_MAP) + "SELECT event_id, label, user_id FROM events JOIN ids USING (user_id)")
def reverse_relabel(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    mapping = L.relabel_ids(e)
    return L.reverse_relabel(L.map_label(e, mapping).drop("user_id"), mapping)


_KNOWN = """ids AS (SELECT user_id, 's' || (row_number() OVER (ORDER BY user_id) - 1) AS label
      FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100))"""


@query(
    "map_label",
    with_(_KNOWN) + "SELECT event_id, user_id, coalesce(label, '-1') AS label FROM events LEFT JOIN ids USING (user_id)",
)
def map_label(spark, sf):
    e = table(spark, sf, "events")
    known = L.relabel_ids(e.where("event_type = 'error' and value > 100"))
    return L.map_label(e.select("event_id", "user_id"), known)


@query("week_bucket", with_("log") + "SELECT event_id, week FROM log")
def week_bucket(spark, sf):
    return L.week_bucket(table(spark, sf, "events")).select("event_id", "week")


@query("week_slice", with_("log") + "SELECT event_id, week - 1 AS week FROM log WHERE week >= 1 AND week < 4")
def week_slice(spark, sf):
    return L.week_bucket(table(spark, sf, "events"), weeks=(1, 4)).select("event_id", "week")


@query("period_bucket", with_("log") + "SELECT week // 3 AS period, count(*) AS n FROM log GROUP BY ALL")
def period_bucket(spark, sf):
    return L.period_bucket(event_log(spark, sf)).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weekday_profile",
    with_(
        "log",
        "days AS (SELECT unnest(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']) AS weekday)",
        "grid AS (SELECT DISTINCT week, weekday FROM log, days)",
        "seen AS (SELECT week, dayname(ts) AS weekday, count(*) AS n FROM log GROUP BY ALL)",
    )
    + "SELECT week, weekday, coalesce(n, 0) AS n FROM grid LEFT JOIN seen USING (week, weekday)",
)
def weekday_profile(spark, sf):
    return L.weekday_profile(event_log(spark, sf))


_UM = "um AS (SELECT user_id, activity AS feature, count(*) AS value FROM log GROUP BY ALL)"


def _user_matrix(spark, sf):
    return event_log(spark, sf).groupBy("user_id", F.col("activity").alias("feature")).agg(F.count(F.lit(1)).alias("value"))


@query(
    "drop_empty_columns",
    with_("log", _UM) + "SELECT user_id, feature, value - 1 AS value FROM um WHERE value - 1 <> 0 AND NOT regexp_matches(feature, '^err')",
)
def drop_empty_columns(spark, sf):
    return L.drop_empty_columns(_user_matrix(spark, sf).withColumn("value", F.col("value") - 1), "^err")


@query(
    "shared_columns",
    """WITH a AS (SELECT l_suppkey AS user_id, l_partkey AS feature, count(*) AS value FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY ALL),
      b AS (SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE year(l_shipdate) = 1997)
      SELECT user_id, feature, value FROM a WHERE feature IN (SELECT feature FROM b)""",
)
def shared_columns(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("feature"), F.year("l_shipdate").alias("y"))
    a = l.where("y = 1996").groupBy("user_id", "feature").agg(F.count(F.lit(1)).alias("value"))
    return L.shared_columns(a, l.where("y = 1997")).select("user_id", "feature", "value")


@query(
    "join_material",
    with_("visits", "material") + "SELECT page_type, of_week, activity, count(*) AS n FROM visits JOIN material USING (page) GROUP BY ALL",
)
def join_material(spark, sf):
    joined = L.join_material(visits(spark, sf), material(spark, sf))
    return joined.groupBy("page_type", "of_week", "activity").agg(F.count(F.lit(1)).alias("n"))


_EXAM = """exams AS (SELECT CAST(substr(task, 3, 1) AS BIGINT) AS exam, user_id, CAST(sum(correct) AS BIGINT) AS score
      FROM uploads WHERE task LIKE 'ex%' GROUP BY ALL)"""
_PRACT = """practice AS (SELECT CAST(dayofyear(date) % 13 AS BIGINT) AS week, user_id, CAST(sum(passed) AS BIGINT) AS practice
      FROM uploads WHERE task NOT LIKE 'ex%' GROUP BY ALL)"""
_ACTW = "activity AS (SELECT week, user_id, count(*) AS n FROM visits GROUP BY ALL)"


def _parts(spark, sf):
    u = uploads(spark, sf)
    exams = u.where(F.col("task").rlike("^ex")).groupBy(F.substring("task", 3, 1).cast("long").alias("exam"), "user_id").agg(F.sum("correct").alias("score"))
    practice = L.without(u, "ex").groupBy((F.dayofyear("date") % 13).cast("long").alias("week"), "user_id").agg(F.sum("passed").alias("practice"))
    activity = visits(spark, sf).groupBy("week", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return activity, practice, exams


@query(
    "join_features",
    with_("visits", "uploads", _EXAM, _PRACT, _ACTW)
    + """SELECT exam, user_id, week, n, practice, score FROM (SELECT a.week, a.user_id, n, practice,
      CASE WHEN a.week <= 3 THEN 1 WHEN a.week <= 7 THEN 2 ELSE 3 END AS ex FROM activity a JOIN practice p
      ON a.week = p.week AND a.user_id = p.user_id) f JOIN exams USING (user_id) WHERE exam = ex""",
)
def join_features(spark, sf):
    return L.join_features(*_parts(spark, sf))


@query(
    "join_exams",
    with_("uploads", _EXAM)
    + """SELECT user_id, CAST(sum(CASE WHEN exam = 1 THEN score ELSE 0 END) AS BIGINT) AS score1,
      CAST(sum(CASE WHEN exam = 2 THEN score ELSE 0 END) AS BIGINT) AS score2,
      CAST(sum(CASE WHEN exam = 3 THEN score ELSE 0 END) AS BIGINT) AS score3 FROM exams GROUP BY user_id""",
)
def join_exams(spark, sf):
    exams = _parts(spark, sf)[2]
    return L.join_exams([exams.where(F.col("exam") == i).select("user_id", F.col("score").alias(f"score{i}")) for i in (1, 2, 3)])


@query(
    "join_week_user",
    with_("visits", "uploads", _PRACT, _ACTW) + "SELECT week, user_id, practice, n FROM practice JOIN activity USING (week, user_id)",
)
def join_week_user(spark, sf):
    activity, practice, _ = _parts(spark, sf)
    return L.join_week_user(practice, activity)


_TOP = "top AS (SELECT user_id FROM exams WHERE exam = 1 AND score >= 2)"


@query("cohort_semi", with_("visits", "uploads", _EXAM, _TOP) + "SELECT user_id, page, activity FROM visits WHERE user_id IN (SELECT user_id FROM top)")
def cohort_semi(spark, sf):
    top = _parts(spark, sf)[2].where("exam = 1 and score >= 2")
    return L.cohort_semi(visits(spark, sf).select("user_id", "page", "activity"), top)


@query("cohort_anti", with_("visits", "uploads", _EXAM, _TOP) + "SELECT user_id, page, activity FROM visits WHERE user_id NOT IN (SELECT user_id FROM top)")
def cohort_anti(spark, sf):
    top = _parts(spark, sf)[2].where("exam = 1 and score >= 2")
    return L.cohort_anti(visits(spark, sf).select("user_id", "page", "activity"), top)


@query(
    "common_members",
    with_(
        "c1 AS (SELECT c_custkey AS node, c_nationkey % 4 AS community, c_acctbal AS score FROM customer)",
        "c2 AS (SELECT o_custkey AS node, o_custkey % 5 AS community, avg(o_totalprice) AS score FROM orders GROUP BY ALL)",
        "m1 AS (SELECT community, avg(score) AS m FROM c1 GROUP BY ALL)",
        "m2 AS (SELECT community, avg(score) AS m FROM c2 GROUP BY ALL)",
    )
    + f"""SELECT c1.node AS node, CAST(c1.community AS BIGINT) AS group1, {rnd('c1.score', 7)} AS score1, {rnd('m1.m', 7)} AS mean1,
      CAST(c2.community AS BIGINT) AS group2, {rnd('c2.score', 7)} AS score2, {rnd('m2.m', 7)} AS mean2
      FROM c1 JOIN m1 ON c1.community = m1.community JOIN c2 ON c1.node = c2.node JOIN m2 ON c2.community = m2.community""",
)
def common_members(spark, sf):
    from pathlore.plans.registry import rounded

    c1 = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 4).alias("community"), F.col("c_acctbal").alias("score"))
    c2 = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.avg("o_totalprice").alias("score"))
    c2 = c2.withColumn("community", F.col("node") % 5)
    return rounded(big(L.common_members(c1, c2)), 7)


@query("pairs_all", "SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM part a, (SELECT DISTINCT p_brand FROM part) b")
def pairs_all(spark, sf):
    return L.pairs_all(table(spark, sf, "part"), "p_brand")


@query("pairs_no_loop", "SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM part a, (SELECT DISTINCT p_brand FROM part) b WHERE src <> dst")
def pairs_no_loop(spark, sf):
    return L.pairs_all(table(spark, sf, "part"), "p_brand", self_loop=False)


@query("sort_log", with_("log") + "SELECT case_id, event_id, activity FROM log ORDER BY case_id, ts, event_id")
def sort_log(spark, sf):
    return event_log(spark, sf).orderBy("case_id", "ts", "event_id").select("case_id", "event_id", "activity")


@query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_k(spark, sf):
    return L.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), 10, [F.desc("p_retailprice"), F.asc("p_partkey")])


@query(
    "top_k_per_group",
    """SELECT p_type, p_partkey, p_retailprice FROM part
      QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 5""",
)
def top_k_per_group(spark, sf):
    part = table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    return L.top_k(part, 5, [F.desc("p_retailprice"), F.asc("p_partkey")], by=["p_type"])


_YEARS = """y6 AS (SELECT o_custkey AS user_id, count(*) AS orders6, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS closed FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1),
      y7 AS (SELECT o_custkey AS user_id, count(*) AS orders7, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS closed FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1)"""


def _years(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("y"), "o_orderstatus")
    return [
        o.where(part).groupBy("user_id").agg(F.count(F.lit(1)).alias(f"orders{i}"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
        for i, part in ((6, "y <= 1995"), (7, "y > 1995"))
    ]


@query(
    "union_fill",
    with_(_YEARS) + "SELECT user_id, orders6, closed, 0 AS orders7 FROM y6 UNION ALL SELECT user_id, 0, closed, orders7 FROM y7",
)
def union_fill(spark, sf):
    return L.union_all(_years(spark, sf))


@query("union_shared", with_(_YEARS) + "SELECT user_id, closed FROM y6 UNION ALL SELECT user_id, closed FROM y7")
def union_shared(spark, sf):
    return L.union_all(_years(spark, sf), "shared")


@query("intersect_members", with_(_YEARS) + "SELECT user_id FROM y6 INTERSECT SELECT user_id FROM y7")
def intersect_members(spark, sf):
    a, b = _years(spark, sf)
    return L.members_in_both(a.select("user_id"), b.select("user_id"))


@query("except_exams", with_("uploads") + "SELECT user_id, task, count(*) AS n FROM uploads WHERE task NOT LIKE 'ex%' GROUP BY ALL")
def except_exams(spark, sf):
    return L.without(uploads(spark, sf), "ex").groupBy("user_id", "task").agg(F.count(F.lit(1)).alias("n"))


@query(
    "transpose_view",
    with_("features") + f"SELECT feature AS vec_id, vec_id AS feature, {rnd('value')} AS value FROM features",
)
def transpose_view(spark, sf):
    from pathlore.operators.spectral import transpose_view as flip

    return out(flip(features(spark, sf), row="vec_id").select("vec_id", "feature", "value"))


@query(
    "wide_pivot",
    with_("log")
    + """SELECT user_id, count(*) FILTER (activity = 'click') AS click, count(*) FILTER (activity = 'error') AS error,
      count(*) FILTER (activity = 'purchase') AS purchase, count(*) FILTER (activity = 'signup') AS signup,
      count(*) FILTER (activity = 'view') AS view FROM log GROUP BY ALL""",
)
def wide_pivot(spark, sf):
    return L.wide(_user_matrix(spark, sf), ["user_id"], "feature", "value", ["click", "error", "purchase", "signup", "view"])
