"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and negative zero removed, so equal results compare equal."""
    return df.select(
        *[
            (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )


def rnd(sql: str, digits: int = 6) -> str:
    return f"(round(({sql})::double, {digits}) + 0.0)"


def big(df: DataFrame) -> DataFrame:
    """Integer columns as bigint."""
    return df.select(
        *[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes]
    )


def out(df: DataFrame) -> DataFrame:
    return rounded(big(df))
