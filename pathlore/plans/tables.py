"""Views that give the standard tables the shape of logs, uploads and matrices, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.operators.log import case_key, week_bucket


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, ts, user_id, activity, value, case_id (date-user), week."""
    e = table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("activity"), "value"
    )
    return week_bucket(case_key(e))


def user_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with one long case per user."""
    return event_log(spark, sf).withColumn("case_id", F.col("user_id").cast("string")).drop("week")


def described_log(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, description: page addresses in the spellings an activity log uses."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), "url")
    kind = F.col("page_id") % 5
    text = (
        F.when(kind == 0, F.concat("path", F.lit(".web.html#top")))
        .when(kind == 1, F.concat(F.lit("/einstein/"), "path"))
        .when(kind == 2, F.concat("path", F.lit("/solution.html correct")))
        .when(kind == 3, F.concat(F.lit("/"), "path", F.lit("/labsheet.html go")))
        .otherwise(F.col("url"))
    )
    return p.select("page_id", text.alias("description"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    exam = F.concat(
        F.lit("ex"), (1 + F.col("l_orderkey") % 3).cast("string"), F.lit("-q"), (1 + F.col("l_partkey") % 4).cast("string")
    )
    task = F.concat(F.lit("task-"), (F.col("l_partkey") % 50).cast("string"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_shipdate").alias("date"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("ca"), (F.col("l_suppkey") % 3).cast("string")).alias("module"),
        F.when(F.col("l_linenumber") <= 2, exam).otherwise(task).alias("task"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).cast("long").alias("correct"),
        F.col("l_quantity").cast("long").alias("passed"),
        (50 - F.col("l_quantity")).cast("long").alias("failed"),
    )


def material(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("page"), F.col("p_type").alias("page_type"), (F.col("p_size") % 13).cast("long").alias("of_week")
    )


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Page visits: page, user_id, ts, week (course week 0-12), activity."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("page"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").alias("ts"),
        (F.dayofyear("l_shipdate") % 13).cast("long").alias("week"),
        F.col("l_returnflag").alias("activity"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, feature, value, label from the embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("feature", "value")).select(
        "vec_id", F.col("feature").cast("long").alias("feature"), F.col("value").cast("double").alias("value"), "label"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, vec array<double>, label."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label")
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    q = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return d.join(q, "doc_id", "left").select(
        F.col("source").alias("user_id"), F.col("doc_id").alias("task"), F.col("text").alias("upload"), "quality"
    )


_CTE = {
    "log": """log AS (SELECT event_id, ts, user_id, event_type AS activity, value,
      concat_ws('-', CAST(CAST(ts AS DATE) AS VARCHAR), CAST(user_id AS VARCHAR)) AS case_id,
      CAST(date_diff('day', (SELECT min(CAST(date_trunc('week', ts) AS DATE)) FROM events),
           CAST(date_trunc('week', ts) AS DATE)) // 7 AS BIGINT) AS week FROM events)""",
    "ulog": """ulog AS (SELECT event_id, ts, user_id, event_type AS activity, value,
      CAST(user_id AS VARCHAR) AS case_id FROM events)""",
    "described": """described AS (SELECT page_id, CASE page_id % 5
      WHEN 0 THEN regexp_replace(url, '^https?://', '') || '.web.html#top'
      WHEN 1 THEN '/einstein/' || regexp_replace(url, '^https?://', '')
      WHEN 2 THEN regexp_replace(url, '^https?://', '') || '/solution.html correct'
      WHEN 3 THEN '/' || regexp_replace(url, '^https?://', '') || '/labsheet.html go'
      ELSE url END AS description FROM pages)""",
    "uploads": """uploads AS (SELECT l_shipdate AS date, o_custkey AS user_id, 'ca' || (l_suppkey % 3) AS module,
      CASE WHEN l_linenumber <= 2 THEN 'ex' || (1 + l_orderkey % 3) || '-q' || (1 + l_partkey % 4)
           ELSE 'task-' || (l_partkey % 50) END AS task,
      CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS BIGINT) AS correct,
      CAST(l_quantity AS BIGINT) AS passed, CAST(50 - l_quantity AS BIGINT) AS failed
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "material": """material AS (SELECT p_partkey AS page, p_type AS page_type,
      CAST(p_size % 13 AS BIGINT) AS of_week FROM part)""",
    "visits": """visits AS (SELECT l_partkey AS page, o_custkey AS user_id, l_shipdate AS ts,
      CAST(dayofyear(l_shipdate) % 13 AS BIGINT) AS week, l_returnflag AS activity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "features": """features AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS feature, CAST(embedding[i] AS DOUBLE) AS value,
      CAST(label AS BIGINT) AS label
      FROM (SELECT vec_id, embedding, label, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))""",
    "submissions": """submissions AS (SELECT source AS user_id, d.doc_id AS task, text AS upload,
      CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
}


def with_(*parts: str) -> str:
    """WITH clause from view names and further ``name AS (...)`` parts."""
    return "WITH " + ",\n".join(_CTE.get(p, p) for p in parts) + "\n"
