"""Projections, filters, labels and joins over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, blocked_product, with_position

# Page naming and page typing of the logs this engine reads.
CLICK_ACTIONS = ("click-0", "click-1", "click-2", "click-3")
PAGE_PATTERN = r"([^\/][\S]+.html)"
PAGE_DROP = ".web"
PRACTICE_PATTERNS = ("correct|incorrect", "^/einstein/")
PAGE_TYPE_RULES = (
    (".html|.web", "Read_Lecture_Note"),
    ("correct|incorrect", "Exercise"),
    ("labsheet|instructions", "Read_Labsheet"),
    ("solution", "Check_solution"),
    ("http|report|dashboard|graphs.html", "Admin_page"),
)
LECTURE_EXCLUDED = ("http", "report.html", "index.html", "dashboard", "graphs.html", "sick", "log.html")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def case_key(log: DataFrame, user: str = "user_id", ts: str = "ts", session: str | None = None) -> DataFrame:
    """``case_id`` = date-user, or date-user-session."""
    parts = [F.to_date(ts).cast("string"), F.col(user).cast("string")]
    if session:
        parts.append(F.col(session).cast("string"))
    return log.withColumn("case_id", F.concat_ws("-", *parts))


def filter_regex(log: DataFrame, patterns: list[str], col: str = "description") -> DataFrame:
    return log.where(F.col(col).rlike("|".join(patterns)))


def page_name(log: DataFrame, col: str = "description") -> DataFrame:
    found = F.regexp_replace(F.regexp_extract(col, PAGE_PATTERN, 1), PAGE_DROP, "")
    name = F.when(F.col(col).rlike("|".join(PRACTICE_PATTERNS)), "Practice").when(
        F.regexp_extract(col, PAGE_PATTERN, 1) != "", found
    )
    return log.withColumn("page_name", F.coalesce(name, F.lit("General")))


def page_type_rules(
    log: DataFrame, rules: tuple[tuple[str, str], ...] = PAGE_TYPE_RULES, col: str = "description"
) -> DataFrame:
    """The last matching rule names the type; rows that match none are dropped."""
    label: Column | None = None
    for pattern, name in reversed(rules):
        hit = F.col(col).rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return log.withColumn("page_type", label).where(F.col("page_type").isNotNull())


def drop_actions(log: DataFrame, actions: tuple[str, ...] = CLICK_ACTIONS, act: str = "activity") -> DataFrame:
    return log.where(~F.col(act).isin(*actions))


def lecture_list(
    log: DataFrame,
    kinds: tuple[str, ...] = ("html",),
    exclude: tuple[str, ...] = (),
    col: str = "description",
) -> DataFrame:
    """Distinct page paths: text before the first space, then before ``#``, never just ``/``."""
    rows = log.where(F.col(col).rlike("|".join(kinds)))
    if exclude:
        rows = rows.where(~F.col(col).rlike("|".join(exclude)))
    head = F.trim(F.split_part(F.col(col), F.lit(" "), F.lit(1)))
    page = F.trim(F.split_part(F.col("_head"), F.lit("#"), F.lit(1)))
    rows = rows.select(head.alias("_head")).where("_head <> '/'")
    return rows.select(page.alias("page")).where("page <> '/'").distinct()


def concept_page(log: DataFrame, col: str = "description") -> DataFrame:
    by_hash = F.split_part(F.col(col), F.lit("#"), F.lit(1))
    by_space = F.split_part(F.col(col), F.lit(" "), F.lit(1))
    return log.withColumn("page", F.when(F.col(col).contains("#"), by_hash).otherwise(by_space))


def context_label(
    log: DataFrame,
    page_type: str = "page_type",
    of_week: str = "of_week",
    act: str = "activity",
    week: str = "week",
    practice: str = "Practice",
) -> DataFrame:
    """``page_type_week`` and ``page_type_week*action``; practice pages take the week of the event."""
    wk = F.when(F.col(page_type) == practice, F.col(week)).otherwise(F.col(of_week))
    label = F.concat_ws("_", F.col(page_type), wk.cast("string"))
    return log.withColumn("page_type_week", label).withColumn(
        "context", F.concat_ws("*", F.col("page_type_week"), F.col(act))
    )


def relabel_ids(ids: DataFrame, col: str = "user_id", policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Dictionary ``(id, label)`` with labels ``s0, s1, ...`` in id order."""
    distinct = ids.select(col).where(F.col(col).isNotNull()).distinct()
    placed = with_position(distinct, [], [col], "_pos", policy)
    return placed.select(col, F.concat(F.lit("s"), (F.col("_pos") - 1).cast("string")).alias("label"))


def reverse_relabel(labelled: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    return labelled.join(mapping, label)


def map_label(df: DataFrame, mapping: DataFrame, col: str = "user_id", missing: str = "-1") -> DataFrame:
    return df.join(mapping, col, "left").withColumn("label", F.coalesce("label", F.lit(missing)))


def monday(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "week")


def week_bucket(
    log: DataFrame,
    ts: str = "ts",
    origin: str | None = None,
    weeks: tuple[int, int] | None = None,
) -> DataFrame:
    """``week`` = calendar weeks (Monday to Sunday) since the first week of the log or ``origin``.

    ``weeks=(a, b)`` keeps a <= week < b and counts from a, as a course calendar does.
    """
    first = F.trunc(F.to_date(F.lit(origin)), "week") if origin else log.agg(F.min(monday(ts))).scalar()
    out = log.withColumn("week", F.floor(F.datediff(monday(ts), first) / 7).cast("long"))
    if weeks:
        out = out.where((F.col("week") >= weeks[0]) & (F.col("week") < weeks[1]))
        out = out.withColumn("week", F.col("week") - weeks[0])
    return out


def period_bucket(log: DataFrame, length: int = 3, week: str = "week") -> DataFrame:
    return log.withColumn("period", F.floor(F.col(week) / length).cast("long"))


def weekday_profile(log: DataFrame, by: str = "week", ts: str = "ts") -> DataFrame:
    """Events per weekday and ``by``, zero-filled, one row each."""
    day = F.date_format(F.to_date(ts), "EEEE")
    seen = log.groupBy(by, day.alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    grid = seen.select(by).distinct().withColumn("weekday", F.explode(F.array(*[F.lit(d) for d in WEEKDAYS])))
    filled = seen.unionByName(grid.withColumn("n", F.lit(0).cast("long")))
    return filled.groupBy(by, "weekday").agg(F.sum("n").alias("n"))


def drop_empty_columns(
    matrix: DataFrame, drop: str | None = None, feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Long form of removing all-zero columns and columns whose name matches ``drop``."""
    out = matrix.where(F.col(value) != 0)
    return out.where(~F.col(feature).rlike(drop)) if drop else out


def shared_columns(left: DataFrame, right: DataFrame, feature: str = "feature") -> DataFrame:
    """Rows of ``left`` whose feature also exists in ``right``."""
    return left.join(right.select(feature).distinct(), feature, "left_semi")


def join_material(log: DataFrame, material: DataFrame, page: str = "page") -> DataFrame:
    """Inner join to the material dictionary; broadcast only if Spark's size limit allows it."""
    return log.join(material, page)


def exam_phase(week: str = "week") -> Column:
    """Exam 1 for weeks 0-3, exam 2 for weeks 4-7, exam 3 later."""
    return F.when(F.col(week) <= 3, 1).when(F.col(week) <= 7, 2).otherwise(3).cast("long")


def join_features(activity: DataFrame, practice: DataFrame, exams: DataFrame) -> DataFrame:
    """Activity and practice of a week beside the exam of that week's phase."""
    weekly = activity.join(practice, ["week", "user_id"])
    return weekly.withColumn("exam", exam_phase()).join(exams, ["exam", "user_id"])


def join_exams(exams: list[DataFrame], on: str = "user_id") -> DataFrame:
    """Full outer join of exam tables with distinct column names; missing values become 0."""
    out = exams[0]
    for other in exams[1:]:
        out = out.join(other, on, "full")
    return out.na.fill(0, [c for c in out.columns if c != on])


def join_week_user(marks: DataFrame, counts: DataFrame) -> DataFrame:
    return marks.join(counts, ["week", "user_id"])


def cohort_semi(df: DataFrame, cohort: DataFrame, on: str = "user_id") -> DataFrame:
    return df.join(cohort, on, "left_semi")


def cohort_anti(df: DataFrame, cohort: DataFrame, on: str = "user_id") -> DataFrame:
    return df.join(cohort, on, "left_anti")


def common_members(
    first: DataFrame, second: DataFrame, member: str = "node", group: str = "community", score: str = "score"
) -> DataFrame:
    """Members shared by group i of ``first`` and group j of ``second`` with scores and group means."""
    sides = []
    for tag, side in (("1", first), ("2", second)):
        means = side.groupBy(group).agg(F.avg(score).alias(f"mean{tag}"))
        sides.append(
            side.join(means, group).select(
                member, F.col(group).alias(f"group{tag}"), F.col(score).alias(f"score{tag}"), f"mean{tag}"
            )
        )
    return sides[0].join(sides[1], member)


def pairs_all(items: DataFrame, col: str = "activity", self_loop: bool = True, blocks: int = 8) -> DataFrame:
    """All ordered pairs of distinct items, spread over ``blocks * blocks`` join keys."""
    vocab = items.select(col).where(F.col(col).isNotNull()).distinct()
    out = blocked_product(vocab.select(F.col(col).alias("src")), vocab.select(F.col(col).alias("dst")), blocks)
    return out if self_loop else out.where("src <> dst")


def union_all(frames: list[DataFrame], mode: str = "fill") -> DataFrame:
    """Stack frames: ``same`` columns, ``shared`` columns only, or all columns with 0 where missing."""
    if mode == "shared":
        keep = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*keep) for f in frames]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=mode == "fill")
    return out.na.fill(0) if mode == "fill" else out


def members_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def without(df: DataFrame, pattern: str, col: str = "task") -> DataFrame:
    """Rows whose ``col`` does not start with ``pattern``."""
    return df.where(~F.col(col).rlike(f"^(?:{pattern})"))


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """First k rows by a total order, or first k per group."""
    if not by:
        return df.orderBy(*order).limit(k)
    # row_number below a filter keeps only k rows per group on the map side
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col("_rn") <= k
    ).drop("_rn")


def wide(df: DataFrame, rows: list[str], cols: str, value: str, names: list[str] | None = None) -> DataFrame:
    """Pivot a long frame at the edge of a pipeline, missing cells 0."""
    grouped = df.groupBy(*rows)
    pivoted = grouped.pivot(cols, names) if names else grouped.pivot(cols)
    out = pivoted.agg(F.sum(value))
    return out.na.fill(0, [c for c in out.columns if c not in rows])
