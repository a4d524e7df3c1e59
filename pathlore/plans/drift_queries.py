from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.operators import drift as D
from pathlore.operators.matrix import case_span, direct_follow
from pathlore.plans.registry import out, query, rnd
from pathlore.plans.tables import event_log, with_

ACTS = ["click", "error", "purchase", "signup", "view"]
SIZE, POP = 100, 4

_NEXT = """nx AS (SELECT case_id, user_id, activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log)"""
_TR = "tr AS (SELECT case_id, src, dst, count(*) AS value FROM nx WHERE dst IS NOT NULL GROUP BY ALL)"
_ACTS = "acts AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS activity)"


def _ent(*cols: str) -> str:
    return " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / 5.0) * log2({c} / 5.0) ELSE 0 END" for c in cols)


def _window_sql(where: str = "", tag: str = "") -> list[str]:
    """CTEs cs, rw, wn, ac, we (window entropies) over the cases that satisfy ``where``."""
    return [
        f"cs{tag} AS (SELECT *, row_number() OVER (ORDER BY start_ts, case_id) - 1 AS pos FROM (SELECT case_id, min(user_id) AS user_id, min(ts) AS start_ts FROM log GROUP BY case_id) {where})",
        f"""rw{tag} AS (SELECT case_id, start_ts, pos, pos // {SIZE} AS win FROM cs{tag} UNION ALL
        SELECT case_id, start_ts, pos, pos // {SIZE} + 1 FROM cs{tag} WHERE pos % {SIZE} = {SIZE - 1})""",
        f"""wn{tag} AS (SELECT win, count(*) AS size, min(start_ts) AS start, max(start_ts) FILTER (pos = (win + 1) * {SIZE} - 2) AS "end" FROM rw{tag}
        WHERE win < (SELECT count(*) FROM cs{tag}) // {SIZE} GROUP BY win)""",
        f"ab{tag} AS (SELECT win, src, dst, count(DISTINCT case_id) AS c FROM rw{tag} JOIN tr USING (case_id) GROUP BY ALL)",
        f"""fp{tag} AS (SELECT wn.win AS win, activity, count(*) FILTER (c = size) AS a, count(*) FILTER (c < size) AS s,
        any_value(wn.start) AS start, any_value(wn."end") AS "end" FROM wn{tag} wn CROSS JOIN acts LEFT JOIN ab{tag} ab ON ab.win = wn.win AND ab.src = activity GROUP BY ALL)""",
        f'we{tag} AS (SELECT win, activity, a, s, 5 - a - s AS n, {_ent("a", "s", "(5 - a - s)")} AS entropy, start, "end" FROM fp{tag})',
    ]


def _ks_sql(sizes: str, tag: str = "") -> list[str]:
    """CTEs for KS tests of adjacent populations; ``sizes`` is a list expression."""
    return [
        f"sz{tag} AS (SELECT CAST(unnest({sizes}) AS BIGINT) AS j)",
        f"nw{tag} AS (SELECT max(win) + 1 AS nw FROM we{tag})",
        f"""sd{tag} AS (SELECT activity, j, win // j AS test, 1 AS side, round(entropy, 9) AS entropy, start, "end" FROM we{tag}, sz{tag} UNION ALL
        SELECT activity, j, win // j - 1, 2, round(entropy, 9), start, "end" FROM we{tag}, sz{tag})""",
        f"ok{tag} AS (SELECT * FROM sd{tag}, nw{tag} WHERE test >= 0 AND (test + 2) * j < nw)",
        f"""cd{tag} AS (SELECT activity, j, test, abs(count(*) FILTER (side = 1) OVER w - count(*) FILTER (side = 2) OVER w) / CAST(j AS DOUBLE) AS gap FROM ok{tag}
        WINDOW w AS (PARTITION BY activity, j, test ORDER BY entropy RANGE UNBOUNDED PRECEDING))""",
        f"dd{tag} AS (SELECT activity, j, test, max(gap) AS d FROM cd{tag} GROUP BY ALL)",
        f"""sp{tag} AS (SELECT activity, j, test, min(start) FILTER (side = 1) AS start1, max("end") FILTER (side = 1) AS end1,
        min(start) FILTER (side = 2) AS start2, max("end") FILTER (side = 2) AS end2 FROM ok{tag} GROUP BY ALL)""",
    ]


_KS_COLS = f"activity, j AS pop_size, test * j AS pos1, (test + 1) * j AS pos2, start1, end1, start2, end2, {rnd('d')} AS d"


def _inputs(spark, sf):
    log = event_log(spark, sf)
    return case_span(log).select("case_id", "user_id", F.col("start_ts")), direct_follow(log)


def _windows(spark, sf):
    w = D.windowed_entropy(*_inputs(spark, sf), SIZE, ACTS)
    # equal mixes must be ties in the rank test whatever the order of their terms
    return w.withColumn("entropy", F.round("entropy", 9))


@query(
    "footprint_entropy",
    with_(
        "log", _NEXT, _TR, _ACTS,
        "n AS (SELECT count(DISTINCT case_id) AS size FROM log)",
        "ab AS (SELECT src, dst, count(DISTINCT case_id) AS c FROM tr GROUP BY ALL)",
        "fp AS (SELECT activity, count(*) FILTER (c = size) AS a, count(*) FILTER (c < size) AS s FROM acts CROSS JOIN n LEFT JOIN ab ON src = activity GROUP BY ALL)",
    )
    + f"SELECT activity, a AS always, s AS sometimes, 5 - a - s AS never, {rnd(_ent('a', 's', '(5 - a - s)'))} AS entropy FROM fp",
)
def footprint_entropy(spark, sf):
    cases, transitions = _inputs(spark, sf)
    return out(D.footprint_entropy(transitions, cases.agg(F.count(F.lit(1)).alias("size")), ACTS))


@query(
    "windowed_entropy",
    with_("log", _NEXT, _TR, _ACTS, *_window_sql())
    + f'SELECT win AS "window", activity, a AS always, s AS sometimes, n AS never, {rnd("entropy")} AS entropy, start, "end" FROM we',
)
def windowed_entropy(spark, sf):
    return out(_windows(spark, sf))


@query("ks_drift", with_("log", _NEXT, _TR, _ACTS, *_window_sql(), *_ks_sql(f"[{POP}]")) + f"SELECT {_KS_COLS} FROM dd JOIN sp USING (activity, j, test)")
def ks_drift(spark, sf):
    return out(D.ks_drift(_windows(spark, sf), POP).drop("p_value"))


@query(
    "ks_drift_growing",
    with_("log", _NEXT, _TR, _ACTS, *_window_sql(), *_ks_sql(f"range({POP}, (SELECT max(win) // 2 + 1 FROM we))"))
    + f"SELECT {_KS_COLS} FROM dd JOIN sp USING (activity, j, test)",
)
def ks_drift_growing(spark, sf):
    return out(D.ks_drift(_windows(spark, sf), POP, growing=True).drop("p_value"))


_P = """pv AS (SELECT activity, j, test, CASE WHEN d * sqrt(j / 2.0) < 0.2 THEN 1.0 ELSE least(1, greatest(0, 2 * list_sum(
      [pow(-1, k - 1) * exp(-2 * k * k * d * d * j / 2.0) for k in range(1, 101)]))) END AS p FROM dd)"""


@query(
    "drift_per_activity",
    with_("log", _NEXT, _TR, _ACTS, *_window_sql(), *_ks_sql(f"[{POP}]"), _P) + f"SELECT activity, test * j AS pos1, {rnd('p')} AS p_value FROM pv",
)
def drift_per_activity(spark, sf):
    return out(D.ks_drift(_windows(spark, sf), POP).select("activity", "pos1", "p_value"))


@query(
    "drift_average",
    with_("log", _NEXT, _TR, _ACTS, *_window_sql(), *_ks_sql(f"[{POP}]"), _P)
    + f"SELECT j AS pop_size, test * j AS pos1, (test + 1) * j AS pos2, {rnd('avg(p)')} AS p_value, count(*) AS n_activities FROM pv GROUP BY j, test",
)
def drift_average(spark, sf):
    return out(D.drift_average(D.ks_drift(_windows(spark, sf), POP)))


_COHORT_PARTS = [
    part
    for tag, where in (("1", "WHERE user_id % 2 = 0"), ("2", "WHERE user_id % 2 = 1"))
    for part in (*_window_sql(where, tag), *_ks_sql("[3]", tag))
]


@query(
    "drift_by_cohort",
    with_("log", _NEXT, _TR, _ACTS, *_COHORT_PARTS)
    + f"SELECT {_KS_COLS}, 'excellent' AS cohort FROM dd1 JOIN sp1 USING (activity, j, test) UNION ALL SELECT {_KS_COLS}, 'weak' AS cohort FROM dd2 JOIN sp2 USING (activity, j, test)",
)
def drift_by_cohort(spark, sf):
    cases, transitions = _inputs(spark, sf)
    cohorts = cases.select("user_id").distinct().withColumn("cohort", F.when(F.col("user_id") % 2 == 0, "excellent").otherwise("weak"))
    return out(D.drift_by_cohort(cases, transitions, cohorts, SIZE, 3, ACTS).drop("p_value"))
