"""Exact top-k by inner product with segment statistics as bounds, coarse to fine.

A vector cut into equal segments is described by each segment's mean and deviation. With ``n``
values per segment, x . y <= sum over segments of n * (mean_x * mean_y + dev_x * dev_y), so
|x - y|^2 has a lower bound and the inner product an upper one. Bounds over 1, 4, 16, ... segments
drop candidates that cannot reach a query's k-th best score; survivors get exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192  # vectors per candidate block
QUERIES = 1024  # vectors per query block
SCALE = 1024.0
SLACK = 1e-9  # relative error allowed for in the floating-point bounds


def _levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; a segment has two values at least."""
    out = [1]
    while out[-1] * 4 <= dim // 2:
        out.append(out[-1] * 4)
    return out


class _Statistics:
    """Segment sums scaled so that a dot product of two rows is the bound."""

    def __init__(self, x: np.ndarray):
        n, dim = x.shape
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.at = {}
        for segments in _levels(dim):
            edges = np.linspace(0, dim, segments + 1).astype(int)
            sizes = np.diff(edges)
            f = x.astype(np.float64)
            mean = np.add.reduceat(f, edges[:-1], axis=1) / sizes if dim else np.zeros((n, 0))
            rest = f - np.repeat(mean, sizes, axis=1)
            dev = np.sqrt(np.add.reduceat(rest**2, edges[:-1], axis=1)) if dim else np.zeros((n, 0))
            self.at[segments] = np.concatenate([mean * np.sqrt(sizes), dev], axis=1)


def _best(query: np.ndarray, query_ids: np.ndarray, pool: np.ndarray, pool_ids: np.ndarray, k: int) -> list[tuple]:
    """(query row, candidate row, score) of each query's ``k`` best candidates in the block."""
    q_stats, p_stats = _Statistics(query), _Statistics(pool)
    order = np.argsort(pool_ids, kind="stable")
    pool, pool_ids = pool[order], pool_ids[order]
    levels = list(q_stats.at)
    slack = SLACK * q_stats.norm[:, None] * p_stats.norm[order][None, :] + 1e-6
    coarse = q_stats.at[levels[0]] @ p_stats.at[levels[0]][order].T + slack
    out = []
    probe = min(len(pool), 4 * k)
    for i in range(len(query)):
        bound, product = coarse[i], lambda rows: pool[rows] @ query[i]  # noqa: B023
        other = pool_ids != query_ids[i]
        first = np.argpartition(-bound, probe - 1)[:probe]
        first = first[other[first]]
        known = np.sort(product(first))[::-1]
        floor = known[k - 1] if len(known) >= k else None
        rows = np.flatnonzero(other if floor is None else other & (bound >= floor))
        for level in levels[1:]:
            if floor is None or len(rows) <= k:
                break
            fine = p_stats.at[level][order[rows]] @ q_stats.at[level][i] + slack[i, rows]
            rows = rows[fine >= floor]
        score = product(rows)
        best = np.lexsort((rows, -score))[:k]  # rows are in the order of their ids
        out += [(i, int(pool_ids[rows[j]]), int(score[j])) for j in best]
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, id, score) with each query's ``k`` best other rows, fewer if there are fewer.

    Components x become floor(1024 * x); the score is their integer inner product (it must fit
    64 bits). Ties go to the smaller id. Rows whose vector is null, empty or holds null or
    non-finite components, and rows without an id, take no part. Vectors of different lengths
    are not compared. Rows that share a query's id count as its own; a query id that occurs more
    than once is one query with the smallest of its vectors. An empty table gives no rows.

    Queries in blocks meet candidates in blocks; a task holds one block of each. Blocks are dealt
    by a hash of the id, so their sizes don't follow any key. Each block pair sends ``k`` rows
    per query, which a grouping by query reduces to ``k``.
    """
    usable = F.size(vec_col) > 0
    finite = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & usable & finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    size = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    pools, asks = max(1, -(-size[0] // CANDIDATES)), max(1, -(-size[1] // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    left = queries.select("id", "v", block(asks).alias("a")).select("id", "v", "a", every(pools).alias("b"))
    right = rows.select("id", "v", block(pools).alias("b")).select("id", "v", "b", every(asks).alias("a"))

    def meet(key, asked, pool):
        a_ids, p_ids = asked.column("id").to_numpy(), pool.column("id").to_numpy()
        a_len, p_len = (t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(t) else np.empty(0, int) for t in (asked, pool))
        found = []
        for n in np.intersect1d(a_len, p_len):
            mine, theirs = np.flatnonzero(a_len == n), np.flatnonzero(p_len == n)
            values = [t.column("v").take(pa.array(i)).combine_chunks().flatten().to_numpy().reshape(-1, n) for t, i in ((asked, mine), (pool, theirs))]
            ids = a_ids[mine]
            found += [(int(ids[i]), c, s) for i, c, s in _best(values[0], ids, values[1], p_ids[theirs], k)]
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "cand", "score"))})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, "query_id long, cand long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("cand").alias(id_col), "score")
