"""Embedding whitening: leading eigenpairs of the covariance by block Jacobi-Davidson.

The covariance is never formed. Every product with a block of vectors is one pass over the table:
a task centres its rows, multiplies them with the block and back, and one sum per task leaves it.
The driver holds the search space only (dimensions x a few times the components). Ritz pairs come
from the projection onto that space; for all pairs that are not settled the correction equation,
projected against the settled and the current vectors, is solved by MINRES, all equations
sharing each pass. Settled pairs are locked; the work ends when every residual is rounding noise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.spans import pack, unpack
from pathlore.session import cut_lineage

ROWS = 4096  # vectors a task multiplies at once
SLOTS = 32  # partial sums that reach the driver
INNER = 8  # MINRES steps of a correction
NEAR = 0.02  # residuals, relative to the largest eigenvalue, from which corrections are solved for
LARGEST = 2.0**46  # absolute value of an entry; beyond, a vector takes no part
LONG = 2**63 - 1


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a batch, some rows at a time."""
    parts = [column.slice(i, ROWS) for i in range(0, len(column), ROWS)]
    return [p.flatten().to_numpy().reshape(len(p), -1) for p in parts]


def _total(rows: DataFrame, part: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of what ``part`` gives for a matrix of rows, added per task, per slot, on the driver."""

    def run(batches):
        total, task = None, 0
        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows else task
            for x in _matrices(batch.column("x")):
                one = part(x)
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "blob": pa.array([pack(*total)], pa.binary())})

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # one order of summation
        arrays = [unpack(b.as_py()) for b in table.column("blob")]
        summed = [np.sum([a[i] for a in arrays], axis=0) for i in range(len(arrays[0]))]
        return pa.table({"task": table.column("task").slice(0, 1), "blob": pa.array([pack(*summed)], pa.binary())})

    partial = rows.select("x", F.spark_partition_id().alias("task")).mapInArrow(run, "task int, blob binary")
    slots = partial.groupBy(F.pmod("task", F.lit(SLOTS)).alias("slot")).applyInArrow(lambda t: fold(t), "task int, blob binary")
    found = [unpack(bytes(r["blob"])) for r in sorted(slots.collect(), key=lambda r: r["task"])]
    return [[f[i] for f in found] for i in range(len(found[0]))]


def _minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for every column of ``b``; columns share each product."""
    size = np.linalg.norm(b, axis=0)
    safe = lambda x: np.where(x > 0, x, 1.0)
    x, v, v_old = np.zeros_like(b), b / safe(size), np.zeros_like(b)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    beta, eta = np.zeros_like(size), size.copy()
    c, c_old, s, s_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        y = apply(v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - beta * v_old
        grown = np.linalg.norm(y, axis=0)
        grown = np.where(grown > 1e-14 * safe(np.abs(alpha)), grown, 0.0)
        delta, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        first = np.hypot(delta, grown)
        live = first > 0
        c_old, s_old, c, s = c, s, np.where(live, delta / safe(first), 1.0), np.where(live, grown / safe(first), 0.0)
        w, w_old = np.where(live, (v - third * w_old - second * w) / safe(first), 0.0), w
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, beta = y / safe(grown) * (grown > 0), v, grown
        if np.all(np.abs(eta) <= reduce * size):
            break
    return x


def _orthonormal(new: np.ndarray, against: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` orthonormal columns of the span of ``new``, orthogonal to ``against``."""
    if most <= 0 or not new.shape[1]:
        return new[:, :0]
    size = np.linalg.norm(new, axis=0)
    new = new / np.where(size > 0, size, 1.0)
    for _ in range(2):
        new = new - against @ (against.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8][:, :most]
    return new


def _complement(apply: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, float]:
    """Basis of a block Krylov space orthogonal to ``locked`` and the largest eigenvalue seen there."""
    new = _orthonormal(random.standard_normal((len(locked), 8)), locked, 8)
    q, aq = new[:, :0], new[:, :0]
    for _ in range(6):
        q, aq = np.hstack([q, new]), np.hstack([aq, apply(new)])
        new = _orthonormal(aq[:, -new.shape[1] :], np.hstack([locked, q]), new.shape[1])
        if not new.shape[1]:
            break
    projected = q.T @ aq
    return q, float(np.linalg.eigvalsh((projected + projected.T) / 2)[-1])


def eigenpairs(apply: Callable[[np.ndarray], np.ndarray], dim: int, count: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator.

    ``apply`` multiplies a matrix of columns. A pair is settled when its residual is below
    8 * max(dim, 64) rounding units of the largest eigenvalue. Unless the search has met the whole
    space, a Krylov space beside the settled pairs must show no larger eigenvalue.
    """
    random = np.random.default_rng(11)
    count, space = min(count, dim), min(dim, 3 * count + 16)
    tolerance = 8 * max(dim, 64) * np.finfo(float).eps
    locked, values, largest = np.zeros((dim, 0)), np.zeros(0), 0.0
    q = np.linalg.qr(random.standard_normal((dim, min(dim, count + 4))))[0]
    aq = apply(q)
    for _ in range(rounds):
        projected = q.T @ aq
        theta, turn = np.linalg.eigh((projected + projected.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        want = count - len(values)
        largest = max(largest, np.abs(theta).max())
        rest = aq[:, :want] - q[:, :want] * theta[:want]
        size = np.linalg.norm(rest, axis=0)
        open_ = np.flatnonzero(size > tolerance * largest)
        settled = int(open_[0]) if len(open_) else min(want, q.shape[1])
        if settled:
            locked, values = np.hstack([locked, q[:, :settled]]), np.append(values, theta[:settled])
            q, aq, rest, theta, want = q[:, settled:], aq[:, settled:], rest[:, settled:], theta[settled:], want - settled
        if not want:
            rest, above = _complement(apply, locked, random) if dim > count + q.shape[1] else (None, -np.inf)
            if above <= values.min() + tolerance * largest:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            q = np.hstack([locked, rest])  # a larger eigenvalue was passed over: start again from all that is known
            aq, locked, values = apply(q), np.zeros((dim, 0)), np.zeros(0)
            continue
        if q.shape[1] + want > space:
            keep = min(q.shape[1], want + 4)
            q, aq = q[:, :keep], aq[:, :keep]
        targets = np.flatnonzero(np.linalg.norm(rest, axis=0) > tolerance * largest)
        around = np.hstack([locked, q[:, :want]])
        project = lambda x: x - around @ (around.T @ x)  # noqa: B023, E731
        shift = theta[targets]
        room = dim - locked.shape[1] - q.shape[1]
        grown = q[:, :0]
        if room and len(targets):
            solve = lambda x: project(apply(project(x)) - shift * x)  # noqa: B023, E731
            near = np.linalg.norm(rest[:, targets], axis=0).max() < NEAR * largest
            steps = INNER if near and room > len(targets) else 1  # far from an eigenvector, and for the last room, the residual does
            grown = _orthonormal(_minres(solve, -project(rest[:, targets]), steps, 0.02), np.hstack([locked, q]), room)
        if room and not grown.shape[1]:
            grown = _orthonormal(random.standard_normal((dim, want)), np.hstack([locked, q]), room)
        if room:
            q, aq = np.hstack([q, grown]), np.hstack([aq, apply(grown)])
        else:  # the whole space: take out what rounding has left
            q = _orthonormal(q, locked, q.shape[1])
            aq = apply(q)
    raise RuntimeError(f"{count - len(values)} of {count} eigenpairs are not settled after {rounds} rounds")


def whiten(
    vectors: DataFrame,
    components: int = 32,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    offset: int = 1_000_000,
) -> DataFrame:
    """One row (id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    An entry c counts as x = floor(scale * c) + offset. With n vectors and sums S of x, the
    components are the unit eigenvectors of the covariance of x (divisor n), numbered from 1 by
    falling eigenvalue e. ``whitened`` is (x - S/n) . component / sqrt(e), ``explained`` e over
    the trace, ``deviation`` the exact sum of (n * x - S)^2 (null where it passes a long),
    ``identity_error`` the largest entry of the covariance of ``whitened`` less the identity.

    Null vectors and those that are empty or hold null, non-finite or absolute entries of 2^46 or
    more take no part, nor do vectors of another length than the most common one (ties: the longer).
    Repeated rows count each, a null id stays null. Where an eigenvalue is zero up to rounding
    (constant dimensions, a single vector), ``whitened`` is null, and with a zero trace ``explained``
    is null too. Without vectors there are no rows. Columns not named are not read.
    """
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    entries = F.transform(vector_col, lambda c: c.cast("double"))
    given = vectors.select(F.col(id_col).alias("id"), entries.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fits))
    schema = f"id {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = given.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim = usual["d"]
    x = F.transform("c", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset))
    rows = cut_lineage(given.where(F.size("c") == dim).select("id", x.alias("x")))

    # exact sums: low and high halves of every entry apart
    halves = _total(rows, lambda x: [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.array([len(x)])])
    n = int(sum(int(c[0]) for c in halves[2]))
    sums = [(sum(int(a[i]) for a in halves[0]) << 32) + sum(int(a[i]) for a in halves[1]) for i in range(dim)]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    left = [s % n for s in sums]
    part = np.array([r / n for r in left])
    centred = lambda x: (x - whole) - part

    def apply(block: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> list[np.ndarray]:
            d = centred(x)
            return [(d.T @ (d @ block)).ravel()]

        return np.sum(_total(rows, product)[0], axis=0).reshape(block.shape) / n

    trace = float(np.sum(_total(rows, lambda x: [np.array([(centred(x) ** 2).sum()])])[0])) / n
    values, units = eigenpairs(apply, dim, components)
    count = len(values)
    real = values > 64 * dim * np.finfo(float).eps * max(trace, 0.0)
    root = np.where(real, np.sqrt(np.where(real, values, 1.0)), np.nan)
    white = lambda x: (centred(x) @ units) / root

    def moments(x: np.ndarray) -> list[np.ndarray]:
        w = white(x)[:, real]
        return [(w.T @ w).ravel(), w.sum(axis=0)]

    error = None
    if real.any():
        square, line = (np.sum(m, axis=0) / n for m in _total(rows, moments))
        error = float(np.abs(square.reshape(real.sum(), -1) - np.outer(line, line) - np.eye(real.sum())).max())
    explained = [float(v) / trace if trace > 0 else None for v in values]
    rest = np.array(left, dtype=object)

    def deviation(x: np.ndarray) -> pa.Array:
        d = x - whole
        most = int(np.abs(d).max(initial=0)) + 1
        if (n * most) ** 2 * dim <= LONG:
            d = d * n - rest.astype(np.int64)
            return pa.array((d * d).sum(axis=1))
        exact = ((d.astype(object) * n - rest) ** 2).sum(axis=1)
        return pa.array([v if v <= LONG else None for v in exact], pa.int64())

    def run(batches):
        for batch in batches:
            lo = 0
            for x in _matrices(batch.column("x")):
                size = len(x)
                again = pa.array(np.repeat(np.arange(size), count))
                w = white(x).ravel()
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(lo, size).take(again),
                        "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                        "n": pa.array(np.full(size * count, n)),
                        "deviation": deviation(x).take(again),
                        "whitened": pa.array(w, mask=np.isnan(w)),
                        "explained": pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(count), size))),
                        "identity_error": pa.array([error] * (size * count), pa.float64()),
                    }
                )
                lo += size

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
