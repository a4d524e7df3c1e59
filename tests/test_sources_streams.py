from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathlore.operators.matrix import direct_follow
from pathlore.plans.tables import event_log, table
from pathlore.sources import ingest as I
from pathlore.sources import sinks as K
from pathlore.streaming import stream as S


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


LINES = """2018-09-24 10:00:00 m1 u-1 s1 load /week01/lab.html#top of page
;; 2018-09-24 a comment with many parts here
2018-09-24 10:00:05 m1 u-1 s1 blur
too short
2018-09-24 10:00:09 m1 u-1 s1 upload x
"""


def test_activity_layout_and_choice(spark, tmp_path):
    base = str(tmp_path / "activity")
    for m in ("m1", "m2"):
        for u in ("u-1", "u-2"):
            for d in ("2018-09-24", "2018-09-25"):
                put(f"{base}/{m}/{u}/{d}", LINES)
    log = I.ingest_activity_log(spark, base)
    assert log.count() == 8 * 3
    first = log.where("activity = 'load'").first()
    assert (first.case_id, first.user_id, first.lifecycle, first.description) == ("2018-09-24-u-1-s1", "u-1", "start", "/week01/lab.html#top of page")
    assert first.ts == datetime(2018, 9, 24, 10)
    assert log.where("activity = 'blur'").first().description is None
    some = I.ingest_activity_log(spark, base, ["m2", "m2"], ["u-2"], ["2018-09-25"], I.SKIPPED_ACTIONS)
    assert some.count() == 2 and some.first().source_file.endswith("m2/u-2/2018-09-25")


def report(**over):
    row = {"date": "2019-03-04 12:00:00", "module": "m1", "user": "u-1", "task": "ex1-q1", "language": "py", "correct": 1, "failed": 2, "passed": 3,
           "version": "1", "timeout": False, "extension": "py", "ip": "0", "upload": "x = 1\nprint(x)"}
    return json.dumps(row | over, indent=1)


def test_report_layouts(spark, tmp_path):
    name = "a.report.2019-03-04-12_00_00.json"
    base = str(tmp_path / "uploads")
    put(f"{base}/m1/u-1/2019-03-04/{name}", report())
    put(f"{base}/m1/u-1/2019-03-04/other.json", report(task="no report"))
    put(f"{base}/m2/u-2/2019-03-05/{name}", report(module="m2", user="u-2", timeout=2.5))
    rows = I.ingest_upload_reports(spark, base).orderBy("user_id").collect()
    assert [(r.user_id, r.timeout, r.passed) for r in rows] == [("u-1", "false", 3), ("u-2", "2.5", 3)]
    assert rows[0].upload == "x = 1\nprint(x)"
    assert I.ingest_upload_reports(spark, base, dates=["2019-03-05"]).count() == 1
    tolerant = str(tmp_path / "tolerant")
    put(f"{tolerant}/2019-03-04/m1/u-1/{name}", report())
    put(f"{tolerant}/2019-03-04/m1/u-2/{name}", '{"date": "2019-')
    good, bad = I.ingest_upload_reports_tolerant(spark, tolerant)
    assert [r.user_id for r in good.collect()] == ["u-1"]
    assert [r.source_file.split("/")[-2] for r in bad.collect()] == ["u-2"]


def test_csv_and_material(spark, tmp_path):
    put(str(tmp_path / "log.csv"), "Unnamed: 0,time:timestamp,concept:name\n0,2018-09-24 10:00:00,load\n1, ,blur\n2,not a time,blur\n")
    log = I.read_csv_log(spark, str(tmp_path / "log.csv"))
    assert log.columns == ["time:timestamp", "concept:name"] and log.count() == 1
    put(str(tmp_path / "m.csv"), "page,week1,week2,ofWeek,pageType\np1,3.0,4.0,1,Lecture\n")
    assert tuple(I.read_material(spark, str(tmp_path / "m.csv")).first()) == ("p1", "Lecture", 1)
    assert {tuple(r) for r in I.read_material_counts(spark, str(tmp_path / "m.csv")).collect()} == {("p1", 0, 3.0), ("p1", 1, 4.0)}


XES = """<log><trace><string key="concept:name" value="c1"/>
<event><string key="concept:name" value="a"/><string key="org:resource" value="u"/><date key="time:timestamp" value="2018-09-24T10:00:00.000+00:00"/></event>
<event><string key="concept:name" value="b"/><date key="time:timestamp" value="2018-09-24T10:01:00.000+00:00"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="a"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    put(str(tmp_path / "log.xes"), XES)
    rows = {(r.case_id, r.pos): r for r in I.read_xes(spark, str(tmp_path / "log.xes")).collect()}
    assert len(rows) == 3 and rows[("c1", 0)].user_id == "u" and rows[("c1", 1)].activity == "b" and rows[("c2", 0)].ts is None
    assert rows[("c1", 1)].ts == datetime(2018, 9, 24, 10, 1)


def test_weekly_writer(spark, sf, tmp_path):
    K.write_weekly(event_log(spark, sf), str(tmp_path / "w"))
    assert sorted(d for d in os.listdir(tmp_path / "w") if d.startswith("week=")) == [f"week={i}" for i in range(5)]
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.count() == event_log(spark, sf).count()
    assert "PartitionFilters: [isnotnull(week" in back.where("week = 2")._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def slices(spark, sf, tmp_path_factory):
    """The events in time order as four files that arrive one by one."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("activity"))
    for i in range(4):
        e.where(f"event_id div 250 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def feed(spark, folder, e):
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_direct_follow_over_batches(spark, slices, tmp_path):
    folder, e = slices
    twin = S.DirectFollowStream(spark, str(tmp_path / "s"))
    got = {tuple(r) for r in twin.run(feed(spark, folder, e)).collect()}
    case = F.concat_ws("-", F.to_date("ts").cast("string"), F.col("user_id").cast("string"))
    want = {tuple(r) for r in direct_follow(e.withColumn("case_id", case)).collect()}
    assert len(os.listdir(tmp_path / "s" / "steps")) == 4
    assert got == want and twin.late().first().late == 0


def test_late_rows_are_counted_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, activity string"
    t = lambda m: datetime(2024, 1, 1, 10, m)
    twin = S.DirectFollowStream(spark, str(tmp_path / "s"))
    twin.process(spark.createDataFrame([(1, t(0), 1, "a"), (2, t(5), 1, "b")], schema), 0)
    second = spark.createDataFrame([(3, t(2), 1, "late"), (4, t(9), 1, "c"), (5, t(9), 2, "x")], schema)
    for _ in range(2):
        twin.process(second, 1)
    assert {(r.src, r.dst): r.value for r in twin.result().collect()} == {("a", "b"): 1, ("b", "c"): 1}
    assert twin.late().first().late == 1


def test_weeks_and_sessions_over_batches(spark, slices):
    folder, e = slices
    edge = e.agg(F.max("ts")).first()[0]
    weekly = S.run_available(S.stream_weekly_activity(feed(spark, folder, e)))
    monday = F.trunc(F.to_date("ts"), "week").cast("timestamp")
    batch = e.groupBy(monday.alias("week_start"), "user_id", "activity").agg(F.count(F.lit(1)).alias("n"))
    closed = batch.where(F.col("week_start") + F.expr("interval 7 days") <= F.lit(edge) - F.expr("interval 1 day"))
    assert {tuple(r) for r in weekly.collect()} == {tuple(r) for r in closed.collect()}
    sessions = S.run_available(S.stream_sessions(feed(spark, folder, e), "2 hours"))
    assert sessions.agg(F.sum("n")).first()[0] == e.where(F.col("ts") <= sessions.agg(F.max("end_ts")).first()[0]).join(
        sessions.select("user_id", "start_ts", "end_ts"), "user_id").where("ts between start_ts and end_ts").count()
