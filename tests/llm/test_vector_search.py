from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.llm import vector_search
from pathlore.llm.vector_search import top_k


def brute(rows, k=10):
    whole = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((i, np.floor(np.array(v, dtype=np.float64) * 1024).astype(np.int64)))
    out = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        v = min((tuple(v) for i, v in whole if i == q))
        scored = sorted((-int(np.dot(v, c)), i) for i, c in whole if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 3, 8, 64])
def test_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(vector_search, "CANDIDATES", 90)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    r = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in r.normal(size=dim).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # ties
    rows += [(2000, None), (2100, []), (2200, [None] * dim), (2300, [float("nan")] * dim), (2400, [float("inf")] * dim)]
    rows += [(None, rows[0][1]), (2500, rows[0][1] + [1.0]), (2600, rows[0][1] + [2.0]), (100, rows[5][1]), (0, [0.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows)


def test_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 5, 3 * 1024 * 1024)]
    assert top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
