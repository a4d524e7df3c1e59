"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.session import cut_lineage


TASK_ROWS = 10_000  # rows that a task of a counted table holds at least
FEW = 100_000  # links up to which the minima per node are small enough to be joined by broadcast


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, in a task per ``TASK_ROWS`` but at least four a core.

    The stage that ends in ``df`` then starts no more tasks than that, whatever the number of
    shuffle partitions; large tables keep their partitions.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it can reach.

    Both steps replace a node's links by links to its smallest neighbour, so a component becomes
    a star in a number of rounds that grows with the logarithm of its size. The minimum per node
    is pre-aggregated and joined back; no node's neighbours meet in one row. Every round is
    written to the shared folder.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _fingerprint(edges)
    while before[0]:
        count = before[0]
        few = lambda df: in_few_tasks(df, count) if count <= FEW else df  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        least = few(least)
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        least = few(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(least, F.col("a") == F.col("u")).select(ends, F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut_lineage(in_few_tasks(small, 2 * count))
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links`` (a, b) between labels or nodes without one."""
    step = cut_lineage(components(links))
    tops = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut_lineage(moved.union(step.join(labels.select("node"), "node", "left_anti")))
