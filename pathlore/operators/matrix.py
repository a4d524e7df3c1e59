"""Activity and transition matrices in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.ordered import (
    CHUNK,
    DEFAULT,
    SkewPolicy,
    cut_rows,
    quantiles,
    with_next,
    with_position,
)

ORDER = ["ts", "event_id"]
STEP = ["week", "case_id", "user_id"]
EDGE = "\u2192"  # between the activities of a transition that is one feature


def _count() -> Column:
    return F.count(F.lit(1))


def _group_share(df: DataFrame, keys: list[str], value: str, fn, out: str) -> DataFrame:
    """value / fn(value) per key. The totals are combined before the shuffle, so no key is gathered."""
    totals = df.groupBy(*keys).agg(fn(value).alias("_total"))
    share = F.when(F.col("_total") == 0, 0.0).otherwise(F.col(value) / F.col("_total"))
    return df.join(totals, keys).withColumn(out, share).drop("_total")


def activity_matrix(log: DataFrame, keys: tuple[str, ...] = ("user_id",), act: str = "activity") -> DataFrame:
    return log.groupBy(*keys, act).agg(_count().alias("n"))


def activity_share(matrix: DataFrame, keys: tuple[str, ...] = ("user_id",), value: str = "n") -> DataFrame:
    return _group_share(matrix, list(keys), value, F.sum, "share")


def activity_relative_max(matrix: DataFrame, keys: tuple[str, ...] = ("user_id",), value: str = "n") -> DataFrame:
    return _group_share(matrix, list(keys), value, F.max, "share")


def _seconds(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def steps(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """One row per adjacent pair of events of a case: src, dst and the seconds between."""
    nexts = with_next(log, ["case_id"], ORDER, {"dst": "activity", "_ts2": "ts"}, policy)
    return nexts.where(F.col("dst").isNotNull()).select(
        *[c for c in STEP if c in log.columns],
        F.col("activity").alias("src"),
        "dst",
        _seconds(F.col("_ts2"), F.col("ts")).alias("seconds"),
    )


def direct_follow(log: DataFrame, mode: str = "count", policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Adjacent pairs per case: ``count``, or ``time`` = summed seconds."""
    value = _count() if mode == "count" else F.sum("seconds")
    found = steps(log, policy)
    keys = [c for c in STEP if c in found.columns]
    return found.groupBy(*keys, "src", "dst").agg(value.alias("value"))


def direct_follow_time(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    return direct_follow(log, "time", policy)


def eventually_follow(log: DataFrame, mode: str = "count", policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Every earlier/later pair of events of a case: count, summed distance or summed seconds.

    Pairs are never built. Each event carries, per activity of its case, how many events of it
    came before and the sum of their positions or times, so the work is events x activities.
    Hot cases run in order ranges; what crosses ranges follows from one row per range.
    """
    keys = [c for c in STEP if c in log.columns]
    at = {
        "count": F.lit(0.0),
        "distance": F.col("_pos").cast("double"),
        "time": F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0),
    }[mode]
    placed = with_position(log, ["case_id"], ORDER, "_pos", policy) if mode == "distance" else log
    if mode == "time":  # times relative to one constant keep the sums small
        zero = log.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1_000_000.0)).scalar()
        at = at - zero
    # one shuffle by case (and range, for hot cases) serves the join, the window and the sums
    events = placed.select(*keys, *ORDER, F.col("activity").alias("dst"), at.alias("_at"))
    events, plain = cut_rows(events, ["case_id"], ORDER, policy, sized_by=log)
    part = ["case_id"] if plain else ["case_id", CHUNK]
    events = events.repartition(*[F.col(c) for c in part])
    seen = events.select(*part, F.col("dst").alias("src")).distinct()
    grid = events.join(seen, part)
    mine = (F.col("src") == F.col("dst")).cast("long")
    before = Window.partitionBy(*part, "src").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns(
        {"_n": F.coalesce(F.sum(mine).over(before), F.lit(0)), "_s": F.coalesce(F.sum(mine * F.col("_at")).over(before), F.lit(0.0))}
    ).where("_n > 0")
    value = F.sum("_n") if mode == "count" else F.sum(F.col("_n") * F.col("_at") - F.col("_s"))
    inside = grid.groupBy(*keys, "src", "dst").agg(value.alias("value"))
    if plain:
        return inside
    sums = events.where(F.col(CHUNK) >= 0).groupBy(*keys, CHUNK, F.col("dst").alias("act")).agg(
        _count().alias("n"), F.sum("_at").alias("s")
    )
    # running sums of each activity over the ranges of its case: ranges x activities rows
    chunks, acts = sums.select(*keys, CHUNK).distinct(), sums.select(*keys, F.col("act").alias("src")).distinct()
    seen = sums.select(*keys, CHUNK, F.col("act").alias("src"), F.col("n").alias("_n1"), F.col("s").alias("_s1"))
    ahead = Window.partitionBy(*keys, "src").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    upto = chunks.join(acts, keys).join(seen, [*keys, CHUNK, "src"], "left").select(
        *keys, CHUNK, "src", F.sum("_n1").over(ahead).alias("n1"), F.sum("_s1").over(ahead).alias("s1")
    ).where("n1 > 0")
    across = upto.join(sums.withColumnRenamed("act", "dst"), [*keys, CHUNK])
    crossing = F.sum(F.col("n1") * F.col("n")) if mode == "count" else F.sum(F.col("n1") * F.col("s") - F.col("s1") * F.col("n"))
    across = across.groupBy(*keys, "src", "dst").agg(crossing.alias("value"))
    return inside.unionByName(across).groupBy(*keys, "src", "dst").agg(F.sum("value").alias("value"))


def direct_follow_with_activity(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Transitions ``a→b`` and activities ``a`` as features of a case; activity names may hold hyphens."""
    keys = [c for c in STEP if c in log.columns]
    moves = direct_follow(log, "count", policy).select(*keys, F.concat_ws(EDGE, "src", "dst").alias("feature"), "value")
    acts = log.groupBy(*keys, F.col("activity").alias("feature")).agg(_count().alias("value"))
    return moves.unionByName(acts)


def transition_share(matrix: DataFrame, keys: tuple[str, ...] = ("case_id",), value: str = "value") -> DataFrame:
    return _group_share(matrix, list(keys), value, F.sum, "share")


def case_to_user(matrix: DataFrame) -> DataFrame:
    keys = [c for c in ("week", "user_id") if c in matrix.columns]
    return matrix.groupBy(*keys, "src", "dst").agg(F.sum("value").alias("value"))


def cumulative_weeks(weekly: DataFrame, keys: tuple[str, ...] = ("user_id", "src", "dst")) -> DataFrame:
    """Value of week w over all weeks up to w. A key has at most one row per week in the window."""
    last = weekly.agg(F.max("week")).scalar()
    w = Window.partitionBy(*keys).orderBy("week")
    runs = weekly.groupBy(*keys, "week").agg(F.sum("value").alias("value")).select(
        *keys,
        F.sum("value").over(w).alias("value"),
        F.col("week").alias("_from"),
        F.coalesce(F.lead("week").over(w) - 1, last).alias("_to"),
    )
    return runs.select(*keys, F.explode(F.sequence("_from", "_to")).alias("week"), "value")


def activity_time(timed: DataFrame) -> DataFrame:
    """Seconds per activity = sum of its outgoing transition times."""
    keys = [c for c in ("week", "user_id") if c in timed.columns]
    return timed.groupBy(*keys, F.col("src").alias("activity")).agg(F.sum("value").alias("seconds"))


def case_span(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.min_by("user_id", F.struct(*ORDER)).alias("user_id"),
    )


def complete_time(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    nexts = with_next(log, ["case_id"], ORDER, {"_ts2": "ts"}, policy)
    return nexts.withColumn("complete_ts", F.coalesce("_ts2", "ts")).drop("_ts2")


def variants(log: DataFrame, k: int = 10, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """The k most frequent activity sequences with their number of cases (ties: shorter first,
    then the smaller first case).

    Cases are grouped by a fingerprint of (position, activity), a sum that combines before the
    shuffle; only one case of each of the k winners is written out as text.
    """
    placed = with_position(log, ["case_id"], ORDER, "_pos", policy)
    prints = placed.groupBy("case_id").agg(
        _count().alias("length"),
        *[
            F.sum(F.xxhash64("_pos", "activity", F.lit(seed)).cast("decimal(20,0)")).alias(f"_f{seed}")
            for seed in (1, 2)
        ],
    )
    keys = ["length", "_f1", "_f2"]
    groups = prints.groupBy(*keys).agg(_count().alias("n"), F.min("case_id").alias("case_id"))
    top = groups.orderBy(F.desc("n"), "length", "case_id").limit(k).select("case_id", "length", "n")
    chosen = log.join(top.select("case_id"), "case_id", "left_semi")
    entries = F.sort_array(F.collect_list(F.struct(*ORDER, "activity")))
    text = chosen.groupBy("case_id").agg(F.concat_ws(">", F.transform(entries, lambda e: e["activity"])).alias("variant"))
    return text.join(top, "case_id").orderBy(F.desc("n"), "length", "case_id").select("variant", "n")


def cooccurrence(tokens: DataFrame, win: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Symmetric counts of tokens at most ``win`` positions apart in one sequence.

    The join key holds the position block, so each key meets at most 3 * win tokens and a long
    sequence spreads like a short one.
    """
    block = F.floor(F.col("pos") / win)
    left = tokens.select(*keys, F.col("pos").alias("p1"), F.col("token").alias("t1"), block.alias("_b"))
    right = tokens.select(
        *keys, F.col("pos").alias("p2"), F.col("token").alias("t2"), F.explode(F.array(block, block - 1)).alias("_b")
    )
    near = left.join(right, [*keys, "_b"]).where("p2 > p1 and p2 - p1 <= " + str(int(win)))
    return _symmetric_counts(near)


def _symmetric_counts(pairs: DataFrame) -> DataFrame:
    """Counts of (t1, t2) in both directions from pairs seen once, with one shuffle."""
    once = pairs.groupBy(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b")).agg(_count().alias("n"))
    there = F.struct(F.col("a").alias("t1"), F.col("b").alias("t2"))
    back = F.struct(F.col("b").alias("t1"), F.col("a").alias("t2"))
    same = F.col("a") == F.col("b")
    ways = F.explode(F.when(same, F.array(there)).otherwise(F.array(there, back)))
    return once.select(ways.alias("x"), F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("n")).select("x.t1", "x.t2", "n")


def cooccurrence_arrays(sequences: DataFrame, tokens: str, win: int) -> DataFrame:
    """The same counts for sequences held as arrays: pairs are made inside the row, so only
    pre-aggregated counts are shuffled."""
    t = F.col(tokens)

    def apart(k: Column) -> Column:
        n = F.greatest(F.size(t) - k, F.lit(0))
        return F.arrays_zip(F.slice(t, F.lit(1), n).alias("t1"), F.slice(t, k + 1, n).alias("t2"))

    near = [apart(F.lit(k)) for k in range(1, win + 1)]
    pairs = sequences.where(F.size(t) > 1).select(F.explode(F.concat(*near)).alias("p"))
    return _symmetric_counts(pairs.select("p.t1", "p.t2"))


def material_by_week(log: DataFrame, page: str = "page") -> DataFrame:
    return log.groupBy(page, "week").agg(_count().alias("n"))


def material_share(log: DataFrame) -> DataFrame:
    counts = log.groupBy("page_type", "of_week").agg(_count().alias("n"))
    total = log.agg(_count()).scalar()
    return counts.withColumn("share", F.col("n") / total)


def user_pagetype_counts(log: DataFrame, by_day: bool = False, ts: str = "ts") -> DataFrame:
    day = [F.to_date(ts).cast("string").alias("day")] if by_day else []
    return log.groupBy("user_id", "page_type", *day).agg(_count().alias("n"))


def activity_upload_counts(base: DataFrame, log: DataFrame, activities: list[str]) -> DataFrame:
    """``base`` beside one count column per chosen activity; users lacking one are dropped (inner)."""
    counts = log.where(F.col("activity").isin(*activities)).groupBy("user_id").agg(
        *[F.count_if(F.col("activity") == a).alias(f"{a}_count") for a in activities]
    )
    present = reduce(lambda x, y: x & y, [F.col(f"{a}_count") > 0 for a in activities])
    return base.join(counts.where(present), "user_id")


def active_split(matrix: DataFrame, activity: str, q: float, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Users above (``active``) or at or below (``less``) a quantile of one activity, zeros counted."""
    users = matrix.groupBy("user_id").agg(
        F.sum(F.when(F.col("activity") == activity, F.col("n")).otherwise(0)).alias("n")
    )
    threshold = quantiles(users, [], "n", {"q": q}, policy).scalar()
    return users.withColumn("split", F.when(F.col("n") > threshold, "active").otherwise("less"))


def crosstab(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Contingency cells with ``All`` margins and the share of each row."""
    n = F.sum(weight) if weight else _count()
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(n.alias("n"))
    cube = cells.where("a is not null and b is not null").cube("a", "b").agg(F.sum("n").alias("n"))
    named = cube.select(F.coalesce("a", F.lit("All")).alias("a"), F.coalesce("b", F.lit("All")).alias("b"), "n")
    rows = named.where("b = 'All'").select("a", F.col("n").alias("_row"))
    return named.join(rows, "a").withColumn("row_share", F.col("n") / F.col("_row")).drop("_row")


def describe(df: DataFrame, cols: list[str], policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Count, mean, sd, min, quartiles and max, one row per column."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {stack}) as (column, value)").where("value is not null")
    moments = long.groupBy("column").agg(
        _count().alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return moments.join(quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, policy), "column")
