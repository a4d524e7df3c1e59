from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.plans.registry import query
from pathlore.plans.tables import with_
from pathlore.streaming import stream as S


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return rows.select("event_id", "ts", "user_id", F.col("event_type").alias("activity"))


@query(
    "stream_weekly_activity",
    """SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, user_id, event_type AS activity, count(*) AS n FROM events
      WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""",
)
def stream_weekly_activity(spark, sf):
    done = S.run_available(S.stream_weekly_activity(_stream(spark, sf)))
    return done.withColumn("week_start", F.col("week_start").cast("timestamp_ntz"))


@query(
    "stream_direct_follow",
    with_("log", "nx AS (SELECT case_id, user_id, activity AS src, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log)")
    + "SELECT case_id, user_id, src, dst, count(*) AS value FROM nx WHERE dst IS NOT NULL GROUP BY ALL",
)
def stream_direct_follow(spark, sf):
    return S.stream_direct_follow(_stream(spark, sf))


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS BIGINT) AS new FROM events),
      s AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS sid FROM g)
      SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, sid
      HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def stream_sessions(spark, sf):
    done = S.run_available(S.stream_sessions(_stream(spark, sf), "6 hours"))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})
