"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster session should carry; none of them changes a result.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("pathlore")
    if master:
        builder = builder.master(master)
    settings = dict(RECOMMENDED)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_DIR: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process on one machine may go without it
    and gets a temporary folder; elsewhere executors would write where nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="pathlore-"))
    return _OWN_DIR[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike a cached frame the written table survives the loss of executors, and unlike an
    RDD checkpoint it keeps its statistics, so the next join is planned on its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pathlore/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
