from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.functions.ordered import with_position
from pathlore.operators import matrix as M
from pathlore.operators.log import join_material
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, material, table, user_log, visits, with_

_ACT = "am AS (SELECT user_id, activity, count(*) AS n FROM log GROUP BY ALL)"
_NEXT = """nx AS (SELECT week, case_id, user_id, activity AS src, ts, lead(activity) OVER w AS dst, lead(ts) OVER w AS ts2
      FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"""
_DF = "df AS (SELECT week, case_id, user_id, src, dst, count(*) AS value FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"
_SEC = "date_diff('microsecond', ts, ts2) / 1000000.0"
_DFT = f"dft AS (SELECT week, case_id, user_id, src, dst, sum({_SEC}) AS value FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"


@query("activity_matrix", with_("log") + "SELECT user_id, activity, count(*) AS n FROM log GROUP BY ALL")
def activity_matrix(spark, sf):
    return M.activity_matrix(event_log(spark, sf))


@query("activity_matrix_weekly", with_("log") + "SELECT week, user_id, activity, count(*) AS n FROM log GROUP BY ALL")
def activity_matrix_weekly(spark, sf):
    return M.activity_matrix(event_log(spark, sf), ("week", "user_id"))


@query("activity_share", with_("log", _ACT) + f"SELECT user_id, activity, n, {rnd('n / sum(n) OVER (PARTITION BY user_id)')} AS share FROM am")
def activity_share(spark, sf):
    return out(M.activity_share(M.activity_matrix(event_log(spark, sf))))


@query("activity_relative_max", with_("log", _ACT) + f"SELECT user_id, activity, n, {rnd('n / max(n) OVER (PARTITION BY user_id)')} AS share FROM am")
def activity_relative_max(spark, sf):
    return out(M.activity_relative_max(M.activity_matrix(event_log(spark, sf))))


@query("direct_follow", with_("log", _NEXT, _DF) + "SELECT * FROM df")
def direct_follow(spark, sf):
    return M.direct_follow(event_log(spark, sf))


@query("direct_follow_time", with_("log", _NEXT, _DFT) + f"SELECT week, case_id, user_id, src, dst, {rnd('value', 3)} AS value FROM dft")
def direct_follow_time(spark, sf):
    from pathlore.plans.registry import rounded

    return rounded(M.direct_follow_time(event_log(spark, sf)), 3)


_POS = "pl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS i FROM log)"
_EV = "FROM pl a JOIN pl b ON a.case_id = b.case_id AND a.i < b.i GROUP BY ALL"
_EVK = "SELECT a.week AS week, a.case_id AS case_id, a.user_id AS user_id, a.activity AS src, b.activity AS dst"


@query("eventually_follow", with_("log", _POS) + f"{_EVK}, count(*) AS value {_EV}")
def eventually_follow(spark, sf):
    return M.eventually_follow(event_log(spark, sf))


@query("eventually_follow_distance", with_("log", _POS) + f"{_EVK}, CAST(sum(b.i - a.i) AS DOUBLE) AS value {_EV}")
def eventually_follow_distance(spark, sf):
    return M.eventually_follow(event_log(spark, sf), "distance")


@query(
    "eventually_follow_time",
    with_("log", _POS) + f"{_EVK}, {rnd('sum(date_diff(' + chr(39) + 'microsecond' + chr(39) + ', a.ts, b.ts)) / 1000000.0', 2)} AS value {_EV}",
)
def eventually_follow_time(spark, sf):
    from pathlore.plans.registry import rounded

    return rounded(M.eventually_follow(event_log(spark, sf), "time"), 2)


_UPOS = "pl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS i FROM ulog)"


@query(
    "eventually_follow_long_cases",
    with_("ulog", _UPOS) + f"SELECT a.case_id AS case_id, a.user_id AS user_id, a.activity AS src, b.activity AS dst, count(*) AS value {_EV}",
)
def eventually_follow_long_cases(spark, sf):
    return M.eventually_follow(user_log(spark, sf))


@query(
    "direct_follow_with_activity",
    with_("log", _NEXT, _DF)
    + """SELECT week, case_id, user_id, src || '→' || dst AS feature, value FROM df UNION ALL
      SELECT week, case_id, user_id, activity, count(*) FROM log GROUP BY ALL""",
)
def direct_follow_with_activity(spark, sf):
    return M.direct_follow_with_activity(event_log(spark, sf))


@query(
    "transition_share",
    with_("log", _NEXT, _DF)
    + f"SELECT week, case_id, user_id, src, dst, value, {rnd('value / sum(value) OVER (PARTITION BY case_id)')} AS share FROM df",
)
def transition_share(spark, sf):
    return out(M.transition_share(M.direct_follow(event_log(spark, sf))))


_USER = "us AS (SELECT week, user_id, src, dst, CAST(sum(value) AS BIGINT) AS value FROM df GROUP BY ALL)"


@query("case_to_user", with_("log", _NEXT, _DF, _USER) + "SELECT * FROM us")
def case_to_user(spark, sf):
    return M.case_to_user(M.direct_follow(event_log(spark, sf)))


@query(
    "cumulative_weeks",
    with_("log", _NEXT, _DF, _USER, "wk AS (SELECT DISTINCT week FROM us)")
    + """SELECT wk.week AS week, user_id, src, dst, CAST(sum(value) AS BIGINT) AS value
      FROM us JOIN wk ON us.week <= wk.week GROUP BY ALL""",
)
def cumulative_weeks(spark, sf):
    return M.cumulative_weeks(M.case_to_user(M.direct_follow(event_log(spark, sf))))


@query(
    "activity_time",
    with_("log", _NEXT, _DFT) + f"SELECT week, user_id, src AS activity, {rnd('sum(value)', 3)} AS seconds FROM dft GROUP BY ALL",
)
def activity_time(spark, sf):
    from pathlore.plans.registry import rounded

    return rounded(M.activity_time(M.direct_follow_time(event_log(spark, sf))), 3)


@query("case_span", with_("log") + "SELECT case_id, min(ts) AS start_ts, max(ts) AS end_ts, min(user_id) AS user_id FROM log GROUP BY case_id")
def case_span(spark, sf):
    return M.case_span(event_log(spark, sf))


@query("complete_time", with_("log", _NEXT) + "SELECT case_id, src AS activity, ts, coalesce(ts2, ts) AS complete_ts FROM nx")
def complete_time(spark, sf):
    return M.complete_time(event_log(spark, sf)).select("case_id", "activity", "ts", "complete_ts")


@query(
    "variants",
    with_("log", "v AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, event_id) AS variant FROM log GROUP BY case_id)")
    + """SELECT variant, n FROM (SELECT variant, count(*) AS n, min(case_id) AS c FROM v GROUP BY variant)
      ORDER BY n DESC, len(string_split(variant, '>')), c LIMIT 10""",
)
def variants(spark, sf):
    return M.variants(event_log(spark, sf), 10)


@query(
    "cooccurrence",
    with_(
        r"words AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents)",
        "tok AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM words))",
    )
    + """SELECT a.token AS t1, b.token AS t2, count(*) AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id
      AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND a.pos <> b.pos GROUP BY ALL""",
)
def cooccurrence(spark, sf):
    words = table(spark, sf, "documents").select(F.split("text", r"\s+").alias("tokens"))
    return M.cooccurrence_arrays(words, "tokens", 3)


_SEQ = "sq AS (SELECT user_id, activity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM log)"


@query(
    "cooccurrence_positions",
    with_("log", _SEQ)
    + """SELECT a.activity AS t1, b.activity AS t2, count(*) AS n FROM sq a JOIN sq b ON a.user_id = b.user_id
      AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 AND a.pos <> b.pos GROUP BY ALL""",
)
def cooccurrence_positions(spark, sf):
    placed = with_position(event_log(spark, sf), ["user_id"], M.ORDER, "pos")
    return M.cooccurrence(placed.withColumnRenamed("activity", "token"), 4, ("user_id",))


@query("material_by_week", with_("visits") + "SELECT page, week, count(*) AS n FROM visits GROUP BY ALL")
def material_by_week(spark, sf):
    return M.material_by_week(visits(spark, sf))


_VM = "vm AS (SELECT * FROM visits JOIN material USING (page))"


@query(
    "material_share",
    with_("visits", "material", _VM) + f"SELECT page_type, of_week, count(*) AS n, {rnd('count(*) / (SELECT count(*) FROM vm)')} AS share FROM vm GROUP BY page_type, of_week",
)
def material_share(spark, sf):
    return out(M.material_share(join_material(visits(spark, sf), material(spark, sf))))


@query("user_pagetype_counts", with_("visits", "material", _VM) + "SELECT user_id, page_type, count(*) AS n FROM vm GROUP BY ALL")
def user_pagetype_counts(spark, sf):
    return M.user_pagetype_counts(join_material(visits(spark, sf), material(spark, sf)))


@query(
    "user_pagetype_daily",
    with_("visits", "material", _VM) + "SELECT user_id, page_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM vm GROUP BY ALL",
)
def user_pagetype_daily(spark, sf):
    return M.user_pagetype_counts(join_material(visits(spark, sf), material(spark, sf)), by_day=True)


@query(
    "activity_upload_counts",
    with_("log")
    + """SELECT user_id, total, click_count, error_count FROM (SELECT user_id, count(*) AS total,
      count(*) FILTER (activity = 'click') AS click_count, count(*) FILTER (activity = 'error') AS error_count
      FROM log GROUP BY user_id) WHERE click_count > 0 AND error_count > 0""",
)
def activity_upload_counts(spark, sf):
    log = event_log(spark, sf)
    base = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return M.activity_upload_counts(base, log, ["click", "error"])


@query(
    "active_split",
    with_("log", "u AS (SELECT user_id, count(*) FILTER (activity = 'click') AS n FROM log GROUP BY user_id)")
    + """SELECT user_id, n, CASE WHEN n > (SELECT quantile_cont(n, 0.6) FROM u) THEN 'active' ELSE 'less' END AS split FROM u""",
)
def active_split(spark, sf):
    return M.active_split(M.activity_matrix(event_log(spark, sf)), "click", 0.6)


@query(
    "crosstab",
    with_(
        "log",
        """c AS (SELECT coalesce(CAST(week AS VARCHAR), 'All') AS a, coalesce(activity, 'All') AS b, count(*) AS n
        FROM log GROUP BY CUBE (week, activity))""",
    )
    + f"SELECT a, b, n, {rnd('n / max(CASE WHEN b = ' + chr(39) + 'All' + chr(39) + ' THEN n END) OVER (PARTITION BY a)')} AS row_share FROM c",
)
def crosstab(spark, sf):
    return out(M.crosstab(event_log(spark, sf), "week", "activity"))


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count({c}) AS n, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS sd, {rnd(f'min({c})', 4)} AS min,
      {rnd(f'max({c})', 4)} AS max, {rnd(f'quantile_cont({c}, 0.25)', 4)} AS q25, {rnd(f'quantile_cont({c}, 0.5)', 4)} AS q50,
      {rnd(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM lineitem"""
        for c in ("l_quantity", "l_discount")
    ),
)
def describe(spark, sf):
    from pathlore.plans.registry import rounded

    return rounded(M.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 4)
