"""Hot-key paths against plain windows, with a policy that makes every key hot."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions.ordered import CHUNK, SkewPolicy, blocked_pairs, blocked_product, cut_rows, quantiles, running_totals, with_next, with_position
from pathlore.operators import matrix as M
from pathlore.operators import process as P
from pathlore.operators import stats as T
from pathlore.plans.tables import event_log, table, user_log

HOT = SkewPolicy(max_rows=0, chunk_rows=150)
# only the largest keys: both routes in one query
SOME = SkewPolicy(max_rows=8, chunk_rows=20)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("policy", [HOT, SOME])
@pytest.mark.parametrize("keys", [["user_id"], [], ["event_type", "user_id"]])
def test_next_and_position(spark, sf, keys, policy):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    assert not cut_rows(e, keys, ["ts", "event_id"], policy)[1]
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    want = e.select("event_id", F.lead("event_id").over(w).alias("nx"), F.row_number().over(w).cast("long").alias("pos"))
    nx = with_next(e, keys, ["ts", "event_id"], {"nx": "event_id"}, policy).select("event_id", "nx")
    pos = with_position(e, keys, ["ts", "event_id"], "pos", policy).select("event_id", "pos")
    assert rows(nx.join(pos, "event_id")) == rows(want)


def test_string_order_and_null_keys(spark):
    data = [(None if i % 3 == 0 else "k", f"n{i:03d}", 1) for i in range(60)]
    df = spark.createDataFrame(data, "k string, name string, one long")
    got = running_totals(df, ["k"], ["name"], {"cum": "one"}, HOT)
    want = df.withColumn("cum", F.sum("one").over(Window.partitionBy("k").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("by", [[], ["event_type"]])
def test_quantiles(spark, sf, by):
    e = table(spark, sf, "events").select("event_type", F.round("value", 0).alias("value"))
    got = quantiles(e, by, "value", {"a": 0.0, "b": 0.37, "c": 1.0}, HOT)
    want = e.groupBy(*by).agg(*[F.percentile("value", F.lit(q)).alias(n) for n, q in (("a", 0.0), ("b", 0.37), ("c", 1.0))])
    for g, w in zip(rows(got), rows(want)):
        assert g[-1] == w[-1] and g[:3] == pytest.approx(w[:3])


@pytest.mark.parametrize("policy", [HOT, SOME])
@pytest.mark.parametrize("mode", ["count", "distance", "time"])
def test_eventually_follow_hot(spark, sf, mode, policy):
    log = user_log(spark, sf)
    a = {r[:4]: r[4] for r in map(tuple, M.eventually_follow(log, mode, policy).select("case_id", "user_id", "src", "dst", "value").collect())}
    b = {r[:4]: r[4] for r in map(tuple, M.eventually_follow(log, mode).select("case_id", "user_id", "src", "dst", "value").collect())}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-6 * max(1, abs(b[k])) for k in a)


def test_steps_variants_and_fitness_hot(spark, sf):
    log = event_log(spark, sf)
    assert rows(M.direct_follow(user_log(spark, sf), policy=HOT)) == rows(M.direct_follow(user_log(spark, sf)))
    assert rows(M.variants(log, 7, HOT)) == rows(M.variants(log, 7))
    model = spark.createDataFrame(P.dfg(log).orderBy("src", "dst").limit(12).collect())
    assert rows(P.dfg_fitness(log, model, HOT)) == rows(P.dfg_fitness(log, model))


@pytest.mark.parametrize("by", [(), ("week",)])
def test_rank_tests_hot(spark, sf, by):
    log = event_log(spark, sf).withColumn("k", F.floor("value"))
    for fn in (T.mann_whitney, T.ks_two_sample):
        a, b = (rows(fn(log, "activity", "k", ("click", "view"), by, p)) for p in (HOT, SkewPolicy()))
        assert [x for r in a for x in r] == pytest.approx([x for r in b for x in r], nan_ok=True)
    for fn in (T.kruskal, T.levene):
        a, b = (rows(fn(log, "activity", "k", by, p)) for p in (HOT, SkewPolicy()))
        assert [x for r in a for x in r] == pytest.approx([x for r in b for x in r], nan_ok=True)


def test_blocks_cover_each_pair_once(spark):
    ids = spark.range(40).select("id")
    pairs = blocked_pairs(ids, "id", 3)
    left = pairs.select("_bi", "_bj", F.col("id").alias("u"), F.col("_block").alias("bu"))
    right = pairs.select("_bi", "_bj", F.col("id").alias("v"), F.col("_block").alias("bv"))
    met = left.join(right, ["_bi", "_bj"]).where("u < v and least(bu, bv) = _bi and greatest(bu, bv) = _bj")
    assert met.count() == 780 and met.select("u", "v").distinct().count() == 780
    grid = blocked_product(ids, ids.withColumnRenamed("id", "b"), 5)
    assert grid.count() == 1600 and grid.distinct().count() == 1600


def test_ordinary_keys_need_no_extra_join(spark, sf):
    plan = with_next(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"nx": "event_type"})._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_chunks_follow_each_key(spark):
    """Fifty hot keys in time spans of their own, days of equal times, ids with a common prefix."""
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 50 * 400 + id div 5000 as int))")
    df = spark.range(50 * 2000).select((F.col("id") % 50).alias("k"), day.alias("ts"), F.format_string("student-000000%06d", "id").alias("name"))
    df = df.union(spark.range(40).select((F.col("id") + 100).alias("k"), F.current_timestamp().alias("ts"), F.lit("x").alias("name")))
    d, plain = cut_rows(df, ["k"], ["ts", "name"], SkewPolicy(max_rows=1000, chunk_rows=500))
    sizes = {(r.k, r[CHUNK]): r["count"] for r in d.groupBy("k", CHUNK).count().collect()}
    assert not plain and sum(sizes.values()) == df.count()
    assert all((c == -1) == (k >= 100) for k, c in sizes) and max(sizes.values()) <= 1000
    whole, _ = cut_rows(df.where("k < 50").drop("k"), [], ["name"], SkewPolicy(max_rows=1000, chunk_rows=500))
    sizes = [r["count"] for r in whole.groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 100_000
