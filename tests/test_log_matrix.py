"""Hand-worked cases and edge rows of the log and matrix operators."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathlore.operators import log as L
from pathlore.operators import matrix as M
from pathlore.operators import process as P
from pathlore.operators import score as S

LOG = "case_id string, user_id long, ts timestamp, event_id long, activity string, week long"


def t(minute, second=0):
    return datetime(2018, 9, 24, 10, minute, second)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("c1", 1, t(0), 1, "a", 0),
        ("c1", 1, t(1), 2, "b", 0),
        ("c1", 1, t(1), 3, "a", 0),  # the same time, later id
        ("c1", 1, t(5), 4, "b", 0),
        ("c2", 2, t(0), 5, "a", 0),  # one event only
        ("c3", 1, t(9), 6, "b", 2),  # user 1 is absent in week 1
        ("c3", 1, t(10), 7, "b", 2),
    ]
    return spark.createDataFrame(rows, LOG)


def as_dict(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_follow_counts_and_times(log):
    assert as_dict(M.direct_follow(log), "case_id", "src", "dst") == {("c1", "a", "b"): 2, ("c1", "b", "a"): 1, ("c3", "b", "b"): 1}
    # time is the sum of seconds, also from the second occurrence on
    assert as_dict(M.direct_follow_time(log), "case_id", "src", "dst") == {("c1", "a", "b"): 300.0, ("c1", "b", "a"): 0.0, ("c3", "b", "b"): 60.0}
    ev = M.eventually_follow(log)
    assert as_dict(ev, "case_id", "src", "dst") == {("c1", "a", "b"): 3, ("c1", "a", "a"): 1, ("c1", "b", "a"): 1, ("c1", "b", "b"): 1, ("c3", "b", "b"): 1}
    assert as_dict(M.eventually_follow(log, "distance"), "case_id", "src", "dst")[("c1", "a", "b")] == 1 + 3 + 1


def test_cumulative_fills_missing_weeks(log):
    m = M.cumulative_weeks(M.case_to_user(M.direct_follow(log)))
    got = as_dict(m, "user_id", "week", "src", "dst")
    assert got[(1, 1, "a", "b")] == 2 and got[(1, 2, "a", "b")] == 2 and got[(1, 2, "b", "b")] == 1
    assert (1, 1, "b", "b") not in got


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    for df in (M.direct_follow(empty), M.eventually_follow(empty), M.variants(empty), M.activity_matrix(empty), M.complete_time(empty), P.dfg(empty), L.relabel_ids(empty)):
        assert df.count() == 0
    assert P.dfg_fitness(empty, spark.createDataFrame([("a", "b")], "src string, dst string")).first()["fit_steps"] is None


def test_variant_ties_go_to_the_shorter(spark):
    rows = [(f"c{i}", i, t(j), 10 * i + j, a, 0) for i, s in enumerate(["ab", "ab", "ba", "aab", "b"]) for j, a in enumerate(s)]
    top = M.variants(spark.createDataFrame(rows, LOG), 3).collect()
    assert [tuple(r) for r in top] == [("a>b", 2), ("b", 1), ("b>a", 1)]


def test_cooccurrence_toy(spark):
    tokens = "x y x z".split()
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(tokens)], "pos long, token string")
    arrays = spark.createDataFrame([(tokens,)], "tokens array<string>")
    want = {("x", "y"): 2, ("y", "x"): 2, ("x", "x"): 2, ("x", "z"): 2, ("z", "x"): 2, ("y", "z"): 1, ("z", "y"): 1}
    assert as_dict(M.cooccurrence(rows, 3), "t1", "t2", value="n") == want
    assert as_dict(M.cooccurrence_arrays(arrays, "tokens", 3), "t1", "t2", value="n") == want
    short = spark.createDataFrame([(["a"],), ([],), (None,)], "tokens array<string>")
    assert M.cooccurrence_arrays(short, "tokens", 3).count() == 0


def test_page_rules(spark):
    df = spark.createDataFrame([("/einstein/q1",), ("/lab/week1.web.html#a",), ("is correct",), ("solution.html",), (None,), ("other",)], "description string")
    names = [r.page_name for r in L.page_name(df).collect()]
    assert names == ["Practice", "lab/week1.html", "Practice", "solution.html", "General", "General"]
    types = {r.description: r.page_type for r in L.page_type_rules(df).collect()}
    assert types == {"/lab/week1.web.html#a": "Read_Lecture_Note", "is correct": "Exercise", "solution.html": "Check_solution"}
    pages = {r.page for r in L.lecture_list(spark.createDataFrame([("/ html",), ("/a.html#x y",), ("# html",)], "description string")).collect()}
    assert pages == {"/a.html", ""}


def test_unknown_label_and_weekdays(spark, log):
    known = spark.createDataFrame([(1, "s0")], "user_id long, label string")
    assert {r.label for r in L.map_label(log, known).where("user_id = 2").collect()} == {"-1"}
    profile = L.weekday_profile(log)
    assert profile.count() == 14 and profile.agg(F.sum("n")).first()[0] == 7
    assert L.week_bucket(log.drop("week"), origin="2018-09-17").first()["week"] == 1


def test_assessment_without_tests(spark):
    ups = spark.createDataFrame([(1, "ex1-a", 1, 3, 1), (1, "ex1-b", 0, 0, 4), (2, "ex1-a", 0, 0, 0), (3, "t", 1, 1, 1)], "user_id long, task string, correct long, passed long, failed long")
    got = {r.user_id: r for r in S.assessment(ups, "ex1").collect()}
    assert set(got) == {1, 2}
    assert (got[1].correct, got[1].per_correct, got[1].per_passed, got[1].submitted) == (1, 0.25, 3 / 8, 2)
    assert got[2].per_passed is None


def test_dependency_and_fitness_small(spark, log):
    g = P.dfg(log)
    dep = as_dict(P.dependency_graph(g, 0.0), "src", "dst", value="dependency")
    assert dep == {("a", "b"): pytest.approx(1 / 4), ("b", "b"): pytest.approx(1 / 2)}
    model = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    fit = P.dfg_fitness(log, model).first()
    assert fit.fit_steps == pytest.approx(2 / 4) and fit.fit_cases == pytest.approx(1 / 3)
    prec = P.dfg_precision(log, model).first()
    assert (prec.seen_edges, prec.open_edges) == (1, 2)
    assert tuple(P.model_size(model).first()) == (3, 2, pytest.approx(2 / 9))
    flow = spark.createDataFrame([("x", "y", 0)], "src string, dst string, n long")
    assert P.dfg_percentage(flow).first()["share"] is None


def test_transition_features_of_hyphenated_activities_stay_apart(spark):
    rows = [("c1", 1, "a-b"), ("c1", 2, "c"), ("c2", 3, "a"), ("c2", 4, "b-c")]
    log = spark.createDataFrame(rows, "case_id string, event_id long, activity string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {(r.case_id, r.feature) for r in M.direct_follow_with_activity(log).collect()}
    assert got == {("c1", "a-b→c"), ("c2", "a→b-c"), ("c1", "a-b"), ("c1", "c"), ("c2", "a"), ("c2", "b-c")}
