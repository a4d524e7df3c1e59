"""Exam and practice scoring, and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, quantiles

# Cut points of the four-grade cohort and its percentile form.
GRADE_CUTS = ((0.7, "excellent"), (0.6, "good"), (0.5, "medium"))
PERCENTILE_CUTS = ((0.8, "excellent"), (0.5, "good"), (0.2, "medium"))
LOWEST = "bad"


def task_sum(uploads: DataFrame, exam: str | None = None) -> DataFrame:
    """Uploads whose task starts with ``exam`` summed per (user, task)."""
    rows = uploads.where(F.col("task").startswith(exam)) if exam else uploads
    return rows.groupBy("user_id", "task").agg(
        *[F.sum(c).alias(c) for c in ("correct", "passed", "failed")], F.count(F.lit(1)).alias("n")
    )


def assessment(uploads: DataFrame, exam: str, n_tests: int = 4) -> DataFrame:
    """Per user: tasks solved, their share of ``n_tests``, tests failed and passed, pass rate, tasks sent in."""
    per_user = task_sum(uploads, exam).groupBy("user_id").agg(
        F.count_if(F.col("correct") >= 1).alias("correct"),
        F.sum("failed").alias("failed"),
        F.sum("passed").alias("passed"),
        F.count(F.lit(1)).alias("submitted"),
    )
    return per_user.select(
        "user_id",
        F.lit(exam).alias("exam"),
        "correct",
        (F.col("correct") / n_tests).alias("per_correct"),
        "failed",
        "passed",
        F.try_divide(F.col("passed"), F.col("passed") + F.col("failed")).alias("per_passed"),
        "submitted",
    )


def adjusted(a: DataFrame) -> DataFrame:
    return a.withColumn("adjusted", (F.col("per_correct") + F.col("per_passed")) / 2)


def grade(assessments: DataFrame, n_exams: int) -> DataFrame:
    """Stacked assessments -> mean share solved over all exams (absent = 0) and pooled pass rate."""
    total = F.sum("passed") + F.sum("failed")
    return assessments.groupBy("user_id").agg(
        (F.sum("per_correct") / n_exams).alias("grade"), F.try_divide(F.sum("passed"), total).alias("per_passed")
    )


def cohort_threshold(a: DataFrame, t: float, value: str = "per_correct") -> DataFrame:
    label = F.when(F.col(value).between(t, 1), "excellent").when((F.col(value) >= 0) & (F.col(value) < t), "weak")
    return a.withColumn("cohort", label).where(F.col("cohort").isNotNull())


def _graded(value: Column, cuts: list[tuple[Column, str]]) -> Column:
    label = None
    for cut, name in cuts:
        label = F.when(value >= cut, name) if label is None else label.when(value >= cut, name)
    return F.when(value.isNotNull(), label.otherwise(LOWEST))


def cohort_fixed4(df: DataFrame, value: str = "mark", cuts=GRADE_CUTS) -> DataFrame:
    return df.withColumn("cohort", _graded(F.col(value), [(F.lit(c), n) for c, n in cuts]))


def cohort_percentile4(
    df: DataFrame, value: str = "mark", by: str = "week", cuts=PERCENTILE_CUTS, policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """The same four grades cut at the percentiles of each week."""
    limits = quantiles(df, [by], value, {f"_q{i}": c for i, (c, _) in enumerate(cuts)}, policy)
    names = [f"_q{i}" for i in range(len(cuts))]
    joined = df.join(limits, by)
    return joined.withColumn("cohort", _graded(F.col(value), [(F.col(q), n) for q, (_, n) in zip(names, cuts)])).drop(*names)


def weekly_mark(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy("week", "user_id").agg(
        F.try_divide(F.sum("passed"), F.sum("passed") + F.sum("failed")).alias("mark"),
        (F.sum("correct") / F.count(F.lit(1))).alias("mark_overall"),
    )


def practice_cumulative(uploads: DataFrame, exam_prefix: str = "ex") -> DataFrame:
    """Non-exam work of a user from the first week of work up to each week.

    correct_adjusted sums, over tasks, the share of correct submissions so far; one row per
    (user, task, week) carries running totals, so nothing is rebuilt from earlier weeks.
    """
    rows = uploads.where(~F.col("task").startswith(exam_prefix))
    weekly = rows.groupBy("user_id", "task", "week").agg(
        *[F.sum(c).alias(c) for c in ("correct", "passed", "failed")], F.count(F.lit(1)).alias("n")
    )
    task = Window.partitionBy("user_id", "task").orderBy("week")
    rate = F.sum("correct").over(task) / F.sum("n").over(task)
    weekly = weekly.withColumn("_rate", rate)
    # the change of a task's share is what a week adds to the user's sum of shares
    weekly = weekly.withColumn("_gain", F.col("_rate") - F.coalesce(F.lag("_rate").over(task), F.lit(0.0)))
    per_week = weekly.groupBy("user_id", "week").agg(
        *[F.sum(c).alias(c) for c in ("correct", "passed", "failed", "n", "_gain")]
    )
    user = Window.partitionBy("user_id").orderBy("week")
    last = rows.agg(F.max("week")).scalar()
    runs = per_week.select(
        "user_id",
        F.col("week").alias("_from"),
        F.coalesce(F.lead("week").over(user) - 1, last).alias("_to"),
        *[F.sum(c).over(user).alias(c) for c in ("correct", "passed", "failed", "n", "_gain")],
    )
    runs = runs.withColumn("week", F.explode(F.sequence("_from", "_to")))
    return runs.select(
        "user_id",
        "week",
        "correct",
        "passed",
        "failed",
        F.col("_gain").alias("correct_adjusted"),
        (F.col("correct") / F.col("n")).alias("cumm_practice"),
        F.try_divide(F.col("passed"), F.col("passed") + F.col("failed")).alias("success_passed_rate"),
    )


def last_submission(uploads: DataFrame, value: str = "upload", ts: str = "date", tie: str | None = None) -> DataFrame:
    order = F.struct(ts, tie) if tie else F.col(ts)
    return uploads.groupBy("user_id", "task").agg(F.max_by(value, order).alias(value), F.max(ts).alias(ts))


def cohort_year_table(members: DataFrame, group: str = "community", year: str = "year") -> DataFrame:
    """Members per community and year: number, share of the year, share of the community."""
    cells = members.groupBy(group, year).agg(F.count(F.lit(1)).alias("number"))
    years = cells.groupBy(year).agg(F.sum("number").alias("_y"))
    groups = cells.groupBy(group).agg(F.sum("number").alias("total_in_group"))
    return cells.join(years, year).join(groups, group).select(
        group,
        year,
        "number",
        (F.col("number") / F.col("_y")).alias("share_of_year"),
        (F.col("number") / F.col("total_in_group")).alias("share_of_group"),
        "total_in_group",
    )
