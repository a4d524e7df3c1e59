"""Concept drift: footprint entropy over windows of cases and tests between window populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.cdf import p_ks
from pathlore.functions.ordered import DEFAULT, SkewPolicy, with_position
from pathlore.operators.stats import ks_two_sample
from pathlore.session import cut_lineage

DISTINCT = 256  # values up to which windows are tested by running counts of each


def _entropy(*counts: Column, total: int) -> Column:
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def footprint_entropy(
    transitions: DataFrame, sizes: DataFrame, activities: list[str], by: tuple[str, ...] = ()
) -> DataFrame:
    """Per sub-log and activity: how many activities follow always, sometimes, never, and the entropy.

    ``transitions``: by, case_id, src, dst, value; ``sizes``: by, size = cases in the sub-log.
    """
    n = len(activities)
    seen = transitions.where((F.col("value") > 0) & F.col("src").isin(activities) & F.col("dst").isin(activities))
    seen = seen.groupBy(*by, "src", "dst").agg(F.count_distinct("case_id").alias("cases"))
    grid = sizes.withColumn("activity", F.explode(F.array(*[F.lit(a) for a in activities])))
    seen = seen.withColumnRenamed("src", "activity")
    full = grid.join(seen, [*by, "activity"], "left")
    always = F.count_if(F.col("cases") == F.col("size"))
    some = F.count_if(F.col("cases") < F.col("size"))
    out = full.groupBy(*by, "activity").agg(always.alias("always"), some.alias("sometimes"))
    out = out.withColumn("never", F.lit(n) - F.col("always") - F.col("sometimes"))
    return out.withColumn("entropy", _entropy(F.col("always"), F.col("sometimes"), F.col("never"), total=n))


def windowed_entropy(
    cases: DataFrame,
    transitions: DataFrame,
    size: int,
    activities: list[str],
    overlap: bool = True,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Cases by start cut into windows; entropy of every activity per window.

    With ``overlap`` a window also holds the last row of the one before and its end date is that
    of its last but one row. A last partial window is dropped.
    """
    placed = with_position(cases, [], ["start_ts", "case_id"], "_pos", policy).withColumn("_pos", F.col("_pos") - 1)
    total = cases.agg(F.count(F.lit(1))).scalar()
    own = F.floor(F.col("_pos") / size)
    also = F.when((F.col("_pos") % size == size - 1), own + 1) if overlap else F.lit(None).cast("long")
    rows = placed.select(
        "case_id", "start_ts", "_pos", F.explode(F.array_compact(F.array(own, also))).alias("window")
    ).where(F.col("window") < F.floor(total / size))
    last = (F.col("window") + 1) * size - (2 if overlap else 1)
    windows = rows.groupBy("window").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("start_ts").alias("start"),
        F.max(F.when(F.col("_pos") == last, F.col("start_ts"))).alias("end"),
    )
    moved = transitions.select("case_id", "src", "dst", "value").join(rows.select("case_id", "window"), "case_id")
    entropy = footprint_entropy(moved, windows.select("window", "size"), activities, ("window",))
    return entropy.join(windows.select("window", "start", "end"), "window")


def _ks_growing(windows: DataFrame, pop_size: int, value: str) -> DataFrame:
    """`ks_drift` of every size from running counts of the distinct values.

    A population is a range of windows, so its counts are a difference of two running counts and the
    test reads three rows per activity, whatever the size. First and last dates come from ranges
    of 2, 4, 8, ... windows, two of which cover a population. Work grows with the tests, of which
    there are windows / size of each size.
    """
    windows = cut_lineage(windows.select("activity", F.col("window").cast("long").alias("window"), "start", "end", F.col(value).cast("double").alias(value)))
    last = windows.agg(F.max("window")).first()[0]
    places = windows.select("activity").distinct().select("activity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last + 1))).alias("at"))
    kinds = windows.where(F.col(value).isNotNull()).groupBy("activity").agg(F.sort_array(F.collect_set(value)).alias("_kinds"))
    per = windows.groupBy("activity", F.col("window").alias("at")).agg(
        F.min("start").alias("s0"), F.max("end").alias("e0"), F.collect_list(value).alias("_values")
    )
    # before place ``at``: the number of windows of each value up to it in order
    order = Window.partitionBy("activity").orderBy("at")
    seen = places.join(per, ["activity", "at"], "left").join(kinds, "activity").withColumn("_values", F.coalesce("_values", F.array().cast("array<double>")))
    most = windows.groupBy("activity").agg(F.count_distinct(value).alias("d")).agg(F.max("d")).first()[0]
    # an activity of fewer values repeats its largest
    upto = lambda k: F.coalesce(F.get("_kinds", F.lit(k)), F.array_max("_kinds"))
    count_of = lambda top: F.size(F.filter("_values", lambda x: x <= top))
    counts = [count_of(upto(k)) for k in range(most)]
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = seen.select("activity", "at", "s0", "e0", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"c{k}") for k, c in enumerate(counts)])
    sizes = max(pop_size, last // 2)
    levels = sizes.bit_length()
    for k in range(1, levels):
        far = 2 ** (k - 1)
        held = held.withColumns({f"s{k}": F.least(f"s{k - 1}", F.lead(f"s{k - 1}", far).over(order)), f"e{k}": F.greatest(f"e{k - 1}", F.lead(f"e{k - 1}", far).over(order))})
    spans = F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.col(f"e{k}").alias("e")) for k in range(levels)])
    held = cut_lineage(held.select("activity", "at", F.array(*[f"c{k}" for k in range(most)]).alias("cum"), spans.alias("spans")))

    # tests t of size j: populations t and t + 1; a test ends before the last window
    size = windows.select("activity").distinct().withColumn("j", F.explode(F.sequence(F.lit(pop_size).cast("long"), F.lit(sizes).cast("long"))))
    tests = size.withColumn("test", F.explode(F.when(2 * F.col("j") <= last, F.sequence(F.lit(0).cast("long"), F.floor(F.lit(last) / F.col("j")) - 2))))
    tests = cut_lineage(tests.repartition("activity", "j"))
    level = (F.length(F.bin("j")) - 1).cast("int")
    found = tests.withColumn("_k", level)
    # the places read: the ends of both populations, and where the second range of either begins
    half = F.pow(F.lit(2), F.col("_k")).cast("long")
    reads = {
        "a": F.col("test") * F.col("j"), "b": (F.col("test") + 1) * F.col("j"), "c": (F.col("test") + 2) * F.col("j"),
        "p": (F.col("test") + 1) * F.col("j") - half, "q": (F.col("test") + 2) * F.col("j") - half,
    }
    cells = found.select("activity", "j", "test", "_k", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("at")) for n, c in reads.items()])).alias("r"))
    cells = cells.select("activity", "j", "test", "_k", "r.n", "r.at").join(held, ["activity", "at"])
    part = lambda n, c: F.max(F.when(F.col("n") == n, c))
    span = F.get("spans", F.col("_k"))
    rows = cells.groupBy("activity", "j", "test").agg(
        *[part(n, F.col("cum")).alias(f"cum_{n}") for n in "abc"], *[part(n, span).alias(f"span_{n}") for n in "abpq"]
    )
    total = lambda x, y: F.transform(F.arrays_zip(F.col(f"cum_{x}").alias("x"), F.col(f"cum_{y}").alias("y")), lambda z: z["y"] - z["x"])
    rows = rows.withColumns({"_one": total("a", "b"), "_two": total("b", "c")})
    n1, n2 = F.element_at("_one", -1), F.element_at("_two", -1)
    gaps = F.transform(F.arrays_zip(F.col("_one").alias("x"), F.col("_two").alias("y")), lambda z: F.abs(z["x"] / n1 - z["y"] / n2))
    d = F.when((n1 > 0) & (n2 > 0), F.array_max(gaps))
    out = rows.select(
        "activity", F.col("j").alias("pop_size"), (F.col("test") * F.col("j")).alias("pos1"), ((F.col("test") + 1) * F.col("j")).alias("pos2"),
        F.least("span_a.s", "span_p.s").alias("start1"), F.greatest("span_a.e", "span_p.e").alias("end1"),
        F.least("span_b.s", "span_q.s").alias("start2"), F.greatest("span_b.e", "span_q.e").alias("end2"), d.alias("d"), n1.alias("_n1"), n2.alias("_n2"),
    )
    return out.where("_n1 + _n2 > 0").withColumn("p_value", p_ks(F.col("d"), F.col("_n1"), F.col("_n2"))).drop("_n1", "_n2")


def ks_drift(
    windows: DataFrame, pop_size: int, growing: bool = False, value: str = "entropy", policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """KS test of each population of ``pop_size`` windows against the next, per activity.

    ``growing`` repeats it for every larger size that still leaves two populations. Windows with few
    distinct values, as entropies are, are then counted once (`_ks_growing`).
    """
    if growing:
        kinds = windows.groupBy("activity").agg(F.count_distinct(value).alias("d")).agg(F.max("d")).first()[0]
        if kinds and kinds <= DISTINCT:
            return _ks_growing(windows, pop_size, value)
    total = windows.agg(F.max("window") + 1).scalar()
    sizes = F.sequence(F.lit(pop_size), F.greatest(F.lit(pop_size), F.floor((total - 1) / 2))) if growing else F.array(F.lit(pop_size))
    rows = windows.select("activity", "window", "start", "end", value, F.explode(sizes).alias("pop_size")).withColumn(
        "pop_size", F.col("pop_size").cast("long")
    )
    pop = F.floor(F.col("window") / F.col("pop_size"))
    # a population is the later side of one test and the earlier side of the next
    sides = F.array(F.struct(pop.alias("test"), F.lit(1).alias("side")), F.struct((pop - 1).alias("test"), F.lit(2).alias("side")))
    rows = rows.select("*", F.explode(sides).alias("_s")).select("*", "_s.test", "_s.side").drop("_s")
    rows = rows.where((F.col("test") >= 0) & ((F.col("test") + 2) * F.col("pop_size") < total))
    key = ("activity", "pop_size", "test")
    tests = ks_two_sample(rows, "side", value, (1, 2), key, policy)
    spans = rows.groupBy(*key).agg(
        *[
            fn(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}")
            for s in (1, 2)
            for c, fn in (("start", F.min), ("end", F.max))
        ]
    )
    out = tests.join(spans, list(key))
    return out.select(
        "activity",
        "pop_size",
        (F.col("test") * F.col("pop_size")).alias("pos1"),
        ((F.col("test") + 1) * F.col("pop_size")).alias("pos2"),
        "start1",
        "end1",
        "start2",
        "end2",
        F.col("statistic").alias("d"),
        "p_value",
    )


def drift_average(tests: DataFrame) -> DataFrame:
    """Mean p over all activities at each position."""
    keys = ["pop_size", "pos1", "pos2"]
    return tests.groupBy(*keys).agg(F.avg("p_value").alias("p_value"), F.count(F.lit(1)).alias("n_activities"))


def drift_by_cohort(
    cases: DataFrame,
    transitions: DataFrame,
    cohorts: DataFrame,
    size: int,
    pop_size: int,
    activities: list[str],
    names: tuple[str, ...] = ("excellent", "weak"),
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """The whole drift test on the cases of each cohort; ``cases`` carries user_id."""
    parts = []
    for name in names:
        members = cohorts.where(F.col("cohort") == name)
        own = cases.join(members, "user_id", "left_semi")
        windows = windowed_entropy(own, transitions, size, activities, policy=policy)
        parts.append(ks_drift(windows, pop_size, policy=policy).withColumn("cohort", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
