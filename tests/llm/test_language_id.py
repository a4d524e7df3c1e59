from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.llm import language_id
from pathlore.llm.language_id import Sample, fit, letters, predict


def brute(score, move, start):
    n, k = score.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = start[path[0]] + sum(score[i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        for i, p in enumerate(path):
            out[i, p] += np.exp(s)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 3)
    r = np.random.default_rng(2)
    length = [1, 7, 3, 0, 6, 2]
    first = np.append(0, np.cumsum(length))
    score, move, start = r.normal(size=(first[-1], 3)) * 2, r.normal(size=(3, 3)), r.normal(size=3)
    got = language_id._marginals(score, first, move, start)
    for i, n in enumerate(length):
        if n:
            s = slice(first[i], first[i + 1])
            assert got[s] == pytest.approx(brute(score[s], move, start))


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), sample=Sample(texts=40))


def test_held_out(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    rows = predict(docs, model, carry=("lang",)).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('de', 'fr') and length(text) > 400").orderBy("doc_id").collect()
    one, two = (next(r.text for r in docs if r.lang == k) for k in ("de", "fr"))
    text = " ".join(one.split()[:40] + two.split()[:25])
    (row,) = predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    parts = {k: sum(p.words for p in row.parts if p.lang == k) for k in ("de", "fr")}
    assert row.lang_pred == "de" and abs(parts["de"] - 40) <= 5 and abs(parts["fr"] - 25) <= 5
    assert len(row.parts) <= 6


def test_odd(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? _"), (4, "²½"), (None, "und the"), (5, "x" * 50_000), (5, "x" * 50_000), (6, "the " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = predict(df, model).collect()
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4}
    assert predict(df.where("false"), model).count() == 0
    none = fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in predict(df, none).collect()} == {("und", 0.0)}


def test_letters():
    assert letters("Été 12x_y") == ["été", "x", "y"] and letters("²") == [] and letters(None) == []
