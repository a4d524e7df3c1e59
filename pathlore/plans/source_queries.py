from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlore.operators.log import week_bucket
from pathlore.operators.process import dfg
from pathlore.plans.registry import query
from pathlore.plans.tables import event_log, table, uploads, with_
from pathlore.session import checkpoint_dir
from pathlore.sources import ingest as I
from pathlore.sources import sinks as K


def _place(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/pathlore/source-{uuid.uuid4().hex}"


def _raw_log(spark, sf) -> str:
    """The events as activity log lines, one folder per module, with comment and short lines."""
    base = _place(spark)
    e = table(spark, sf, "events")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    user = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    action = F.when(F.col("value") > 200, "upload").otherwise(F.col("event_type"))
    line = F.concat_ws(" ", when, F.concat(F.lit("ca"), (F.col("event_id") % 3).cast("string")), user, F.lit("s1"), action, F.concat(F.lit("/page "), "props"))
    line = F.when(F.col("event_id") % 10 == 7, F.concat(F.lit(";; "), line)).when(F.col("event_id") % 10 == 8, F.lit("cut off line")).otherwise(line)
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).select(line.alias("value")).write.text(f"{base}/ca{i}/all")
    return base


_RAW = """raw AS (SELECT strftime(ts, '%Y-%m-%d') || '-u-' || user_id || '-s1' AS case_id, CASE WHEN value > 200 THEN 'upload' ELSE event_type END AS activity,
      date_trunc('second', ts) AS ts, 'u-' || user_id AS user_id, 'ca' || (event_id % 3) AS module, '/page ' || props AS description
      FROM events WHERE event_id % 10 NOT IN (7, 8))"""
_COLS = "case_id, activity, ts, user_id, module, description"


def _ntz(df):
    return df.select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "module", "description")


@query("ingest_activity_log", with_(_RAW) + f"SELECT {_COLS} FROM raw")
def ingest_activity_log(spark, sf):
    return _ntz(I.ingest_activity_log(spark, _raw_log(spark, sf)))


@query("ingest_filtered", with_(_RAW) + f"SELECT {_COLS} FROM raw WHERE module IN ('ca0', 'ca2')")
def ingest_filtered(spark, sf):
    return _ntz(I.ingest_activity_log(spark, _raw_log(spark, sf), modules=["ca0", "ca2"], users=["all"]))


@query("ingest_activity_excluding", with_(_RAW) + f"SELECT {_COLS} FROM raw WHERE activity <> 'upload'")
def ingest_activity_excluding(spark, sf):
    return _ntz(I.ingest_activity_log(spark, _raw_log(spark, sf), exclude=I.SKIPPED_ACTIONS))


def _raw_reports(spark, sf, broken: bool) -> str:
    base = _place(spark)
    u = uploads(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "module", F.col("user_id").cast("string").alias("user"), "task", "correct", "failed", "passed"
    )
    line = F.to_json(F.struct(*u.columns))
    if broken:
        line = F.when(F.col("passed") == 13, F.expr("substring(to_json(struct(date, module)), 1, 20)")).otherwise(line)
    u.select(line.alias("value")).write.text(f"{base}/all/all/all")
    return base


_REP = "SELECT date, module, CAST(user_id AS VARCHAR) AS user_id, task, correct, failed, passed FROM uploads"


def _report_cols(df):
    return df.select(F.col("date").cast("timestamp_ntz").alias("date"), "module", "user_id", "task", "correct", "failed", "passed")


@query("ingest_upload_reports", with_("uploads") + _REP)
def ingest_upload_reports(spark, sf):
    return _report_cols(I.ingest_upload_reports(spark, _raw_reports(spark, sf, False), pattern=r"\.txt$", multi_line=False))


@query("ingest_upload_reports_tolerant", with_("uploads") + _REP + " WHERE passed <> 13")
def ingest_upload_reports_tolerant(spark, sf):
    return _report_cols(I.ingest_upload_reports_tolerant(spark, _raw_reports(spark, sf, True), pattern=r"\.txt$", multi_line=False)[0])


@query("upload_report_rejects", with_("uploads") + "SELECT count(*) AS rejects FROM uploads WHERE passed = 13")
def upload_report_rejects(spark, sf):
    rejects = I.ingest_upload_reports_tolerant(spark, _raw_reports(spark, sf, True), pattern=r"\.txt$", multi_line=False)[1]
    return rejects.agg(F.count(F.lit(1)).alias("rejects"))


@query("read_csv_log", "SELECT event_id, event_type AS activity, date_trunc('second', ts) AS ts FROM events WHERE event_id % 9 <> 4")
def read_csv_log(spark, sf):
    path = _place(spark)
    e = table(spark, sf, "events")
    when = F.when(F.col("event_id") % 9 == 4, " ").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = e.select(F.col("event_id").alias("Unnamed: 0"), "event_id", F.col("event_type").alias("concept:name"), when.alias("time:timestamp"))
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    log = I.read_csv_log(spark, path)
    return log.select(F.col("event_id").cast("long").alias("event_id"), F.col("`concept:name`").alias("activity"), F.col("`time:timestamp`").cast("timestamp_ntz").alias("ts"))


@query("write_weekly", with_("log") + "SELECT event_id, user_id, activity, week FROM log")
def write_weekly(spark, sf):
    path = _place(spark)
    K.write_weekly(week_bucket(event_log(spark, sf)).select("event_id", "user_id", "activity", "week"), path)
    return spark.read.schema("event_id long, user_id long, activity string, week long").parquet(path)


@query(
    "read_xes",
    with_("log") + "SELECT case_id, activity, date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS user_id, 'start' AS lifecycle FROM log",
)
def read_xes(spark, sf):
    path = _place(spark)
    pair = lambda key, col: F.struct(F.lit(key).alias("_key"), col.alias("_value"))
    event = F.struct(
        F.array(pair("concept:name", F.col("activity")), pair("org:resource", F.col("user_id").cast("string")), pair("lifecycle:transition", F.lit("start"))).alias("string"),
        F.array(pair("time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).alias("date"),
    )
    # one trace element per event, so no case is gathered to write it
    traces = event_log(spark, sf).select(F.array(pair("concept:name", F.col("case_id"))).alias("string"), F.array(event).alias("event"))
    traces.write.format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)
    return I.read_xes(spark, path).select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "lifecycle")


_NEXT = "nx AS (SELECT activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log)"


@query("export_edges", with_("log", _NEXT) + "SELECT src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL GROUP BY ALL")
def export_edges(spark, sf):
    path = _place(spark)
    K.export_edges(dfg(event_log(spark, sf)), path)
    return spark.read.option("header", "true").schema("src string, dst string, n long").csv(path)
