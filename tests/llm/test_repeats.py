"""Byte and word passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.llm.substring_dedup import drop_repeated_passages
from pathlore.llm.suffix_dedup import collection_suffixes, drop_repeated_bytes


def brute_bytes(rows, window):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, window):
    first = {}
    for i, t in rows:
        ws = (t or "").encode().split()
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p : p + window])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [text(40) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared).split(" ")
            lo = r.randint(0, 15)
            parts += [r.choice([" ", "\n", ""]).join(["", " ".join(s[lo : r.randint(lo, 40)])]), text(r.randint(0, 30))]
        rows.append((i * 7 % 120, r.choice([" ", "\t", "\n\n"]).join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # exact copies
    rows += [(300, None), (301, ""), (302, "a" * 400), (303, "a" * 300), (304, "x y " * 200), (305, " ".join(shared))]
    rows += [(306, "\x0b\x0c \n"), (307, "é" * 60), (308, "z" + "é" * 60), (309, text(3000))]
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_bytes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = drop_repeated_bytes(df)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows, 50)
    spans = out.selectExpr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start) = n_removed as ok").distinct().collect()
    assert [tuple(r) for r in spans] == [(True,)]


@pytest.mark.parametrize("seed", [5, 6])
def test_words(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = drop_repeated_passages(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 20)


def test_many_buckets(spark, monkeypatch):
    from pathlore.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_BYTES", 4000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 900)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows, 50)
    got = drop_repeated_passages(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute_words(rows, 20)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_bytes(empty).count() == 0
    assert drop_repeated_passages(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, 1), (None, long, 1), (4, long, 2), (4, long, 2), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, kept int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in drop_repeated_passages(df).collect())
    assert got == [(False, 4, 0), (False, 4, 0), (False, 5, 0), (True, 0, 40), (True, 0, 40)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in drop_repeated_bytes(df).collect())
    assert got == [(False, 4, 0), (False, 4, 0), (False, 5, 0), (True, 0, len(long)), (True, 0, len(long))]


def test_suffix_order():
    r = np.random.default_rng(3)
    strings = [bytes(r.choice([97, 98, 99], size=r.integers(0, 30)).astype(np.uint8)) for _ in range(60)]
    strings += [b"aaaa", b"aaaa", b"abab" * 5]
    string, start, lcp, bwt = collection_suffixes(strings)
    suffixes = [strings[s][i:] for s, i in zip(string, start)]
    assert suffixes == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == lcp[k]
    assert all(c == (strings[s][i - 1] if i else -1) for s, i, c in zip(string, start, bwt))
