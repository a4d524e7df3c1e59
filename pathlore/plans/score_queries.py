from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.operators import score as S
from pathlore.plans.registry import big, out, query, rnd
from pathlore.plans.tables import submissions, table, uploads, with_

_TASK = """ts AS (SELECT user_id, task, substr(task, 1, 3) AS exam, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(passed) AS BIGINT) AS passed,
      CAST(sum(failed) AS BIGINT) AS failed, count(*) AS n FROM uploads WHERE task LIKE 'ex%' GROUP BY ALL)"""
_ASSESS = """assess AS (SELECT user_id, exam, count(*) FILTER (correct >= 1) AS correct, count(*) FILTER (correct >= 1) / 4.0 AS per_correct,
      CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(passed) AS BIGINT) AS passed,
      CASE WHEN sum(passed) + sum(failed) > 0 THEN sum(passed) / (sum(passed) + sum(failed)) END AS per_passed,
      count(*) AS submitted FROM ts GROUP BY ALL)"""


def _all_exams(spark, sf):
    u = uploads(spark, sf)
    return reduce(DataFrame.unionByName, [S.assessment(u, f"ex{i}") for i in (1, 2, 3)])


@query("task_sum", with_("uploads", _TASK) + "SELECT user_id, task, correct, passed, failed, n FROM ts WHERE exam = 'ex1'")
def task_sum(spark, sf):
    return S.task_sum(uploads(spark, sf), "ex1")


@query(
    "assessment",
    with_("uploads", _TASK, _ASSESS)
    + f"SELECT user_id, exam, correct, {rnd('per_correct')} AS per_correct, failed, passed, {rnd('per_passed')} AS per_passed, submitted FROM assess WHERE exam = 'ex1'",
)
def assessment(spark, sf):
    return out(S.assessment(uploads(spark, sf), "ex1"))


@query(
    "adjusted_performance",
    with_("uploads", _TASK, _ASSESS) + f"SELECT user_id, exam, {rnd('(per_correct + per_passed) / 2')} AS adjusted FROM assess",
)
def adjusted_performance(spark, sf):
    return out(S.adjusted(_all_exams(spark, sf)).select("user_id", "exam", "adjusted"))


@query(
    "grade",
    with_("uploads", _TASK, _ASSESS)
    + f"""SELECT user_id, {rnd('sum(per_correct) / 3')} AS grade, {rnd('CASE WHEN sum(passed) + sum(failed) > 0 THEN sum(passed) / (sum(passed) + sum(failed)) END')} AS per_passed
      FROM assess GROUP BY user_id""",
)
def grade(spark, sf):
    return out(S.grade(_all_exams(spark, sf), 3))


for _t in (0.4, 0.5, 0.6):

    @query(
        f"cohort_threshold_{int(_t * 100)}",
        with_("uploads", _TASK, _ASSESS)
        + f"SELECT user_id, exam, CASE WHEN per_correct >= {_t} THEN 'excellent' ELSE 'weak' END AS cohort FROM assess WHERE per_correct BETWEEN 0 AND 1",
    )
    def cohort_threshold(spark, sf, t=_t):
        return S.cohort_threshold(_all_exams(spark, sf), t).select("user_id", "exam", "cohort")


_WEEKLY = f"""wk AS (SELECT CAST(dayofyear(date) % 13 AS BIGINT) AS week, * FROM uploads)"""
_MARK = """marks AS (SELECT week, user_id, CASE WHEN sum(passed) + sum(failed) > 0 THEN sum(passed) / (sum(passed) + sum(failed)) END AS mark,
      sum(correct) / count(*) AS mark_overall FROM wk GROUP BY week, user_id)"""


def _weekly(spark, sf):
    return uploads(spark, sf).withColumn("week", (F.dayofyear("date") % 13).cast("long"))


@query("weekly_mark", with_("uploads", _WEEKLY, _MARK) + f"SELECT week, user_id, {rnd('mark')} AS mark, {rnd('mark_overall')} AS mark_overall FROM marks")
def weekly_mark(spark, sf):
    return out(S.weekly_mark(_weekly(spark, sf)))


@query(
    "cohort_fixed4",
    with_("uploads", _WEEKLY, _MARK)
    + "SELECT week, user_id, CASE WHEN mark >= 0.7 THEN 'excellent' WHEN mark >= 0.6 THEN 'good' WHEN mark >= 0.5 THEN 'medium' ELSE 'bad' END AS cohort FROM marks",
)
def cohort_fixed4(spark, sf):
    return S.cohort_fixed4(S.weekly_mark(_weekly(spark, sf))).select("week", "user_id", "cohort")


@query(
    "cohort_percentile4",
    with_("uploads", _WEEKLY, _MARK, "lim AS (SELECT week, quantile_cont(mark, 0.8) AS p80, quantile_cont(mark, 0.5) AS p50, quantile_cont(mark, 0.2) AS p20 FROM marks GROUP BY week)")
    + """SELECT week, user_id, CASE WHEN mark >= p80 THEN 'excellent' WHEN mark >= p50 THEN 'good' WHEN mark >= p20 THEN 'medium' ELSE 'bad' END AS cohort
      FROM marks JOIN lim USING (week)""",
)
def cohort_percentile4(spark, sf):
    return S.cohort_percentile4(S.weekly_mark(_weekly(spark, sf))).select("week", "user_id", "cohort")


@query(
    "practice_cumulative",
    with_(
        "uploads",
        _WEEKLY,
        "p AS (SELECT * FROM wk WHERE task NOT LIKE 'ex%')",
        "w AS (SELECT DISTINCT week AS w FROM p)",
        "t AS (SELECT user_id, w AS week, task, sum(correct) AS correct, sum(passed) AS passed, sum(failed) AS failed, count(*) AS n FROM p JOIN w ON p.week <= w.w GROUP BY ALL)",
    )
    + f"""SELECT user_id, week, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed,
      {rnd('sum(correct / n)')} AS correct_adjusted, {rnd('sum(correct) / sum(n)')} AS cumm_practice,
      {rnd('CASE WHEN sum(passed) + sum(failed) > 0 THEN sum(passed) / (sum(passed) + sum(failed)) END')} AS success_passed_rate FROM t GROUP BY user_id, week""",
)
def practice_cumulative(spark, sf):
    return out(S.practice_cumulative(_weekly(spark, sf)))


@query(
    "last_submission",
    with_("uploads", "s AS (SELECT user_id, task, passed, failed, date, passed * 100 + failed AS tie FROM uploads)")
    + "SELECT user_id, task, max_by(passed, (date, passed)) AS passed, max(date) AS date FROM s GROUP BY user_id, task",
)
def last_submission(spark, sf):
    return S.last_submission(uploads(spark, sf), "passed", tie="passed")


@query(
    "last_submission_text",
    with_("submissions") + "SELECT user_id, max_by(upload, task) AS upload, max(task) AS last_task FROM submissions GROUP BY user_id",
)
def last_submission_text(spark, sf):
    s = submissions(spark, sf).withColumns({"date": F.col("task"), "task": F.lit("all")})
    return S.last_submission(s).select("user_id", "upload", F.col("date").alias("last_task"))


@query(
    "cohort_year_table",
    f"""WITH c AS (SELECT CAST(o_custkey % 6 AS BIGINT) AS community, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS number FROM orders GROUP BY ALL)
      SELECT community, year, number, {rnd('number / sum(number) OVER (PARTITION BY year)')} AS share_of_year,
      {rnd('number / sum(number) OVER (PARTITION BY community)')} AS share_of_group,
      CAST(sum(number) OVER (PARTITION BY community) AS BIGINT) AS total_in_group FROM c""",
)
def cohort_year_table(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 6).alias("community"), F.year("o_orderdate").alias("year"))
    return out(big(S.cohort_year_table(o)))
