"""Readers for activity logs, upload reports, CSV logs and XES traces."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

# Line format and file names of the raw data.
COMMENT = ";;"
LINE_PARTS = 7
LINE_MINIMUM = 6
SKIPPED_ACTIONS = ("upload", "is-lab-exam:")
REPORT_NAME = r".report.(|21|20|19|18|)\d{2}-[0-9][0-9]-[0-9][0-9]-[0-9][0-9]_[0-9][0-9]_[0-9][0-9].json$"

REPORT_SCHEMA = StructType(
    [StructField("date", TimestampType())]
    + [StructField(n, StringType()) for n in ("module", "user", "task", "language")]
    + [StructField(n, LongType()) for n in ("correct", "failed", "passed")]
    + [StructField(n, StringType()) for n in ("version", "timeout", "extension", "ip", "upload")]
)


def _segment(from_end: int) -> Column:
    """Part of the file path, 1 = file name."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-from_end))


def _folders(base: str, first: list[str] | None) -> list[str]:
    root = base.rstrip("/")
    return [f"{root}/{name}" for name in dict.fromkeys(first)] if first else [root]


def _chosen(df: DataFrame, wanted: dict[int, list[str] | None]) -> DataFrame:
    """Keeps files whose path parts are listed; Spark skips the other files before reading."""
    for depth, names in wanted.items():
        if names:
            df = df.where(_segment(depth).isin(*names))
    return df


def ingest_activity_log(
    spark: SparkSession,
    base: str,
    modules: list[str] | None = None,
    users: list[str] | None = None,
    dates: list[str] | None = None,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Event log of the files ``base/module/user/date``; an empty choice means all.

    Comment lines and lines with fewer than six parts are dropped, and so are the actions in
    ``exclude``.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(_folders(base, modules))
    lines = _chosen(lines, {2: users, 1: dates})
    part = F.split("value", " ", LINE_PARTS)
    parts = lines.select(part.alias("p"), F.col("_metadata.file_path").alias("source_file"))
    parts = parts.where((F.size("p") >= LINE_MINIMUM) & (F.get("p", F.lit(0)) != COMMENT))
    at = lambda i: F.get("p", F.lit(i))
    log = parts.select(
        F.concat_ws("-", at(0), at(3), at(4)).alias("case_id"),
        at(5).alias("activity"),
        F.try_to_timestamp(F.concat_ws(" ", at(0), at(1))).alias("ts"),
        at(3).alias("user_id"),
        at(2).alias("module"),
        F.lit("start").alias("lifecycle"),
        at(6).alias("description"),
        "source_file",
    )
    return log.where(~F.col("activity").isin(*exclude)) if exclude else log


def _reports(spark: SparkSession, folders: list[str], multi_line: bool, permissive: bool) -> DataFrame:
    schema = StructType(REPORT_SCHEMA.fields + ([StructField("_corrupt_record", StringType())] if permissive else []))
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", str(multi_line).lower())
    reader = reader.option("mode", "PERMISSIVE" if permissive else "FAILFAST")
    return reader.json(folders)


def ingest_upload_reports(
    spark: SparkSession,
    base: str,
    modules: list[str] | None = None,
    users: list[str] | None = None,
    dates: list[str] | None = None,
    pattern: str = REPORT_NAME,
    multi_line: bool = True,
) -> DataFrame:
    """Reports of the files ``base/module/user/date/file``; a broken file fails the job."""
    rows = _reports(spark, _folders(base, modules), multi_line, False)
    rows = _chosen(rows, {3: users, 2: dates}).where(_segment(1).rlike(pattern))
    return rows.withColumn("source_file", F.col("_metadata.file_path")).withColumnRenamed("user", "user_id")


def ingest_upload_reports_tolerant(
    spark: SparkSession,
    base: str,
    dates: list[str] | None = None,
    modules: list[str] | None = None,
    users: list[str] | None = None,
    pattern: str = REPORT_NAME,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Reports of ``base/date/module/user/file`` and, apart, the broken ones with their file."""
    rows = _reports(spark, _folders(base, dates), multi_line, True)
    rows = _chosen(rows, {3: modules, 2: users}).where(_segment(1).rlike(pattern))
    rows = rows.withColumn("source_file", F.col("_metadata.file_path")).withColumnRenamed("user", "user_id")
    fields = [c for c in rows.columns if c not in ("_corrupt_record", "source_file")]
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in fields])
    broken = F.col("_corrupt_record").isNotNull() | empty
    rejects = rows.where(broken).select("source_file", F.col("_corrupt_record").alias("content"))
    return rows.where(~broken).drop("_corrupt_record"), rejects


def read_csv_log(spark: SparkSession, path: str, ts: str = "time:timestamp") -> DataFrame:
    """CSV with header; index columns without a name are dropped, rows without a readable time too."""
    rows = spark.read.option("header", "true").csv(path)
    named = [c for c in rows.columns if not c.startswith("Unnamed") and not re.fullmatch(r"_c\d+", c)]
    rows = rows.select(*[F.col(f"`{c}`") for c in named])
    rows = rows.withColumn(ts, F.try_to_timestamp(F.nullif(F.trim(F.col(f"`{ts}`")), F.lit(""))))
    return rows.where(F.col(f"`{ts}`").isNotNull())


_XES = StructType(
    [StructField("_key", StringType()), StructField("_value", StringType())]
)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Event log from XES traces."""
    from pyspark.sql.types import ArrayType

    event = StructType([StructField("string", ArrayType(_XES)), StructField("date", ArrayType(_XES))])
    schema = StructType([StructField("string", ArrayType(_XES)), StructField("event", ArrayType(event))])
    traces = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)

    def value(pairs: Column, key: str) -> Column:
        return F.get(F.filter(pairs, lambda p: p["_key"] == key), F.lit(0))["_value"]

    rows = traces.select(value(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("pos", "e"))
    return rows.select(
        "case_id",
        value(F.col("e.string"), "concept:name").alias("activity"),
        F.try_to_timestamp(value(F.col("e.date"), "time:timestamp")).alias("ts"),
        value(F.col("e.string"), "org:resource").alias("user_id"),
        value(F.col("e.string"), "lifecycle:transition").alias("lifecycle"),
        F.col("pos").cast("long").alias("pos"),
    )


def read_material(spark: SparkSession, path: str) -> DataFrame:
    """Material dictionary (page, week1 ... weekN, ofWeek, pageType) as (page, page_type, of_week)."""
    rows = spark.read.option("header", "true").csv(path)
    page = rows.columns[0]
    return rows.select(F.col(f"`{page}`").alias("page"), F.col("pageType").alias("page_type"), F.col("ofWeek").cast("long").alias("of_week"))


def read_material_counts(spark: SparkSession, path: str) -> DataFrame:
    """The week columns of a material dictionary in long form: page, week (from 0), n."""
    rows = spark.read.option("header", "true").csv(path)
    weeks = [c for c in rows.columns if c.startswith("week")]
    cells = F.array(*[F.struct(F.lit(int(c[4:]) - 1).cast("long").alias("week"), F.col(c).cast(DoubleType()).alias("n")) for c in weeks])
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("page"), F.explode(cells).alias("c")).select("page", "c.week", "c.n")
