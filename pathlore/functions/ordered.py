"""Ordered computations that stay parallel when one key holds a large part of the rows.

A window partitioned by a key alone puts the whole key into one task. Here the rows per key are
counted first (key columns only, combined before the shuffle). If no key has more than
``SkewPolicy.max_rows`` rows, the plan is the plain window. Otherwise the rows of every such key,
and only those, are dealt by range of (key, order columns) into partitions of about
``chunk_rows`` rows, whose number the partition is kept as the row's "chunk". The window runs per
(key, chunk), and a table with one row per hot (key, chunk) carries the missing value over the
chunk edge. What is hot depends on the key's own rows, not on the size of the table; the number
of hot keys and of chunks has no limit, and a chunk may end between any two rows.

The rows with their chunks are written to the shared folder and read by every branch of the plan,
so a task that is run again after a lost executor sees the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlore.session import cut_lineage

CHUNK = "_chunk"


@dataclass(frozen=True)
class SkewPolicy:
    """A key with more than ``max_rows`` rows is cut into ranges of about ``chunk_rows`` rows."""

    max_rows: int = 1_000_000
    chunk_rows: int = 500_000


DEFAULT = SkewPolicy()


def cut_rows(
    df: DataFrame, keys: list[str], order: list[str], policy: SkewPolicy = DEFAULT, sized_by: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """``df`` with ``_chunk``, and whether no key is hot. The chunk is -1 for rows of ordinary keys.

    Chunks rise with the order within a key; nulls come first in both. ``sized_by`` is a frame
    with the same key columns and at least as many rows per key that is cheaper to count.
    """
    counted = (sized_by if sized_by is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (counted.agg(F.max("_rows")).first()[0] or 0) <= policy.max_rows:
        return df.withColumn(CHUNK, F.lit(-1)), True
    rows = cut_lineage(df)
    if keys:
        names = {k: f"_h_{k}" for k in keys}
        hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > policy.max_rows)
        hot = cut_lineage(hot.withColumnsRenamed(names))
        same = [rows[k].eqNullSafe(hot[n]) for k, n in names.items()]
        cold, rows = rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")
        size = hot.agg(F.sum("_rows")).first()[0] or 0
    else:
        cold, size = rows.limit(0), rows.count()
    ranges = max(2, -(-size // policy.chunk_rows))
    dealt = rows.repartitionByRange(ranges, *[F.col(c) for c in dict.fromkeys([*keys, *order])])
    dealt = cut_lineage(dealt.withColumn(CHUNK, F.spark_partition_id()))
    return cold.withColumn(CHUNK, F.lit(-1)).unionByName(dealt), False


def _edge_join(d: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (key, chunk), the partitioning the window already made; matches null keys."""
    renamed = edges.select(
        *[F.col(k).alias(f"_e_{k}") for k in keys],
        F.col(CHUNK).alias("_e_chunk"),
        *[c for c in edges.columns if c not in keys and c != CHUNK],
    )
    on = d[CHUNK] == renamed["_e_chunk"]
    for k in keys:
        on = on & d[k].eqNullSafe(renamed[f"_e_{k}"])
    return d.join(renamed, on, "left").drop("_e_chunk", *[f"_e_{k}" for k in keys])


def with_next(
    df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Adds each ``new: source`` of ``cols`` as the value of the following row of the key."""
    payload = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    d, plain = cut_rows(df, keys, order, policy)
    if plain:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.lead(c).over(w) for n, c in cols.items()})
    heads = d.where(F.col(CHUNK) >= 0).groupBy(*keys, CHUNK).agg(
        F.min_by(payload, F.struct(*order)).alias("_head")
    )
    after = Window.partitionBy(*keys).orderBy(CHUNK)
    heads = heads.select(*keys, CHUNK, F.lead("_head").over(after).alias("_head")).where("_head is not null")
    d = d.withColumn("_next", F.lead(payload).over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    d = _edge_join(d, heads, keys).withColumn("_next", F.coalesce("_next", "_head"))
    return d.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in cols])


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str],
    policy: SkewPolicy = DEFAULT,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Adds inclusive running sums ``new: source`` per key. ``order`` must be a total order.

    ``sized_by`` is a frame with the same keys and at least as many rows that is cheaper to count.
    """
    d, plain = cut_rows(df, keys, order, policy, sized_by)
    if plain:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.where(F.col(CHUNK) >= 0).groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, CHUNK, *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums])
    d = d.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    d = _edge_join(d, totals, keys)
    return d.select(
        *df.columns, *[(F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums]
    )


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Adds the 1-based row number of each row within its key."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, keys, order, {out: "_one"}, policy).drop("_one")


def value_ranks(
    df: DataFrame, by: list[str], value: str, counts: dict[str, Column], policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """One row per distinct value: counts, and running counts ``cum_<name>`` up to that value.

    Rows collapse to value counts before any shuffle, so repeated values cost nothing.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
    return running_totals(hist, by, [value], {f"cum_{n}": n for n in counts}, policy, sized_by=df)


def quantiles(
    df: DataFrame, by: list[str], value: str, shares: dict[str, float], policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``shares``."""
    ranks = value_ranks(df, by, value, {"_c": F.count(F.lit(1))}, policy)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        joined = ranks.join(sizes, by)
    else:
        joined = ranks.withColumn("_n", sizes.scalar())
    first, last = F.col("cum__c") - F.col("_c"), F.col("cum__c") - 1
    aggs = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * F.lit(float(share))
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= k) & (k <= last), F.col(value))).alias(f"_{side}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    out = joined.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in shares
        ],
    )


def blocked_pairs(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Copies each row to every unordered pair of hash blocks that its block belongs to.

    The pair ``(_bi, _bj)`` then meets all rows of both blocks, so any two rows meet in
    exactly one group whose size is about ``2 * rows / blocks``.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    return df.withColumn("_block", block).select("*", other).withColumns(
        {"_bi": F.least("_block", "_other"), "_bj": F.greatest("_block", "_other")}
    ).drop("_other")


MANY_BLOCKS = 16  # whose pairs keep the cores of a machine busy
BLOCK_ROWS = 16_384


def pair_blocks(rows: int, block: int, row_cells: int = 1, cells: int = 2 * BLOCK_ROWS) -> int:
    """Number of hash blocks for all pairs of ``rows``: of about ``block`` rows each up to `MANY_BLOCKS`.

    Every row is copied once a block, so more blocks than the cores need only fill the disk: beyond,
    there are as many as keep `BLOCK_ROWS` rows a block and ``cells`` cells a pair of blocks.
    """
    fewest = max(MANY_BLOCKS, -(-rows // BLOCK_ROWS), -(-2 * rows * row_cells // cells))
    return max(1, min(-(-rows // block), fewest))


def tiled_pairs(rows: DataFrame, key: str, blocks: int, tile: int, prepare: Callable, give: Callable, schema: str) -> DataFrame:
    """``give`` over tiles of all pairs of ``rows``, whose results are the rows of the frame returned.

    A pair of blocks is one task: ``prepare`` gets its rows once, as a table sorted by ``key``, and
    ``give`` what it made of them and the places of at most ``tile`` rows of either side. Both sides
    are the same places or have none in common, and any two rows meet in one tile. A tile's result
    leaves the task before the next is made, so memory is bounded by the tile, whatever the block.
    """

    def run(names: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(key).combine_chunks()
        home, state = table.column("_block").to_numpy(), prepare(table)
        left, right = (np.flatnonzero(home == n.as_py()).astype(np.int32) for n in names)
        for i in range(0, len(left), tile):
            for j in range(i if names[0] == names[1] else 0, len(right), tile):
                yield from give(state, left[i : i + tile], right[j : j + tile]).combine_chunks().to_batches()

    # the pairs are many more than the rows read, so the number of tasks is not left to their bytes
    tasks = min(blocks * (blocks + 1) // 2, 4096)
    return blocked_pairs(rows, key, blocks).repartition(tasks, "_bi", "_bj").groupBy("_bi", "_bj").applyInArrow(run, schema)


def met_pairs(left: np.ndarray, right: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Places (smaller, larger) of the pairs of a tile, those in ``met`` if given, and where they stand in it.

    The smaller place stays the same over runs of rows, which Parquet keeps in next to nothing.
    """
    up = left[:, None] < right[None, :]
    down = left[:, None] > right[None, :] if left[0] != right[0] else np.zeros_like(up)
    i, j = np.nonzero(up if met is None else up & met)
    y, x = np.nonzero((down if met is None else down & met).T)
    i, j, first = np.append(i, x), np.append(j, y), len(i)
    a, b = left[i], right[j]
    a[first:], b[first:] = b[first:], a[first:].copy()
    return a, b, (i, j)


def blocked_product(left: DataFrame, right: DataFrame, blocks: int = 8) -> DataFrame:
    """Every row of ``left`` beside every row of ``right`` as an equi-join on ``blocks ** 2`` keys.

    For results that are a full grid by definition; both sides are distinct labels.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.withColumn("_i", F.pmod(F.xxhash64(*left.columns), F.lit(blocks)).cast("int")).withColumn("_j", every)
    b = right.withColumn("_j", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int")).withColumn("_i", every)
    return a.join(b, ["_i", "_j"]).drop("_i", "_j")
