"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_weekly(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """One Parquet folder per week. The rebalance hint groups rows by week and splits a week that
    is too large for one task, so neither many small files nor one slow writer results."""
    df.hint("rebalance", "week").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("week").parquet(path)


def export_edges(edges: DataFrame, path: str) -> None:
    """Edge list as CSV with header."""
    edges.write.mode("overwrite").option("header", "true").csv(path)
