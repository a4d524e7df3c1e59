"""Structured Streaming twins of the weekly log operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, with_next
from pathlore.session import checkpoint_dir


def _event_time(log: DataFrame, delay: str) -> DataFrame:
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_weekly_activity(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per (week, user, activity); weeks start on Monday (the epoch is a Thursday)."""
    week = F.window("ts", "7 days", startTime="4 days")
    counted = _event_time(log, delay).groupBy(week.alias("w"), "user_id", "activity").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("week_start"), "user_id", "activity", "n")


def stream_sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    found = _event_time(log, delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    return found.select("user_id", "start_ts", "end_ts", "n")


def run_available(df: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all present input into Parquet and returns what it has written."""
    spark = df.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/pathlore/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/data")
    writer.option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


class DirectFollowStream:
    """Adjacent pairs per (day, user) case over micro-batches.

    The last event of each open case is kept as a table per batch in the shared folder. A batch
    joins the cases it touches with that table and runs the batch operator on the few rows, so a
    busy user is split as in batch. Every batch writes under its own id and reads the one before,
    so a batch that is run again after a failure gives the same files. Rows older than the last
    event of their case are counted as late; cases of days before the horizon are dropped.
    """

    COLUMNS = ["case_id", "user_id", "ts", "event_id", "activity"]

    def __init__(self, spark: SparkSession, path: str, keep_days: int = 2, policy: SkewPolicy = DEFAULT):
        self.spark, self.path, self.keep_days, self.policy = spark, path.rstrip("/"), keep_days, policy

    def _state(self, batch: int, schema) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/state/{batch}")

    def process(self, rows: DataFrame, batch: int) -> None:
        case = F.concat_ws("-", F.to_date("ts").cast("string"), F.col("user_id").cast("string"))
        rows = rows.withColumn("case_id", case).select(*self.COLUMNS).persist()
        state = self._state(batch - 1, rows.schema)
        last = state.select("case_id", F.col("ts").alias("_ts"), F.col("event_id").alias("_id"))
        marked = rows.join(last, "case_id", "left")
        late = F.struct("ts", "event_id") < F.struct(F.col("_ts").alias("ts"), F.col("_id").alias("event_id"))
        late = F.coalesce(late, F.lit(False)) & F.col("_ts").isNotNull()
        marked.where(late).groupBy("case_id").agg(F.count(F.lit(1)).alias("late")).write.mode("overwrite").parquet(f"{self.path}/late/{batch}")
        fresh = marked.where(~late).select(*self.COLUMNS)
        carried = state.join(fresh.select("case_id").distinct(), "case_id", "left_semi")
        both = fresh.unionByName(carried)
        steps = with_next(both, ["case_id"], ["ts", "event_id"], {"dst": "activity"}, self.policy).where("dst is not null")
        counts = steps.groupBy("case_id", "user_id", F.col("activity").alias("src"), "dst").agg(F.count(F.lit(1)).alias("value"))
        counts.write.mode("overwrite").parquet(f"{self.path}/steps/{batch}")
        newest = both.agg(F.max(F.to_date("ts"))).first()[0]
        ends = state.unionByName(fresh).groupBy("case_id").agg(F.max_by(F.struct(*self.COLUMNS), F.struct("ts", "event_id")).alias("r")).select("r.*")
        if newest is not None:
            ends = ends.where(F.to_date("ts") > F.date_sub(F.lit(newest), self.keep_days))
        ends.write.mode("overwrite").parquet(f"{self.path}/state/{batch}")
        rows.unpersist()

    def run(self, log: DataFrame) -> DataFrame:
        """Consumes all present input; returns the counts per case and pair."""
        query = log.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/offsets")
        query.trigger(availableNow=True).start().awaitTermination()
        return self.result()

    def result(self) -> DataFrame:
        parts = self.spark.read.parquet(f"{self.path}/steps/*")
        return parts.groupBy("case_id", "user_id", "src", "dst").agg(F.sum("value").alias("value"))

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/late/*").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def stream_direct_follow(log: DataFrame, path: str | None = None, keep_days: int = 2, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Direct-follow counts of a streamed log (user_id, ts, event_id, activity)."""
    spark = log.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/pathlore/stream-{uuid.uuid4().hex}"
    return DirectFollowStream(spark, base, keep_days, policy).run(log)
