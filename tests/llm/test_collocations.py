from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathlore.llm import collocations
from pathlore.llm.collocations import _bits, pair_key, score


def brute(rows, least=10, first=2000, share=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    f[lang or "und", tuple(words[i : i + n])] += 1
    out = []
    for lang in {k[0] for k in f}:
        able = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in able.items()):
                continue
            s, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first]):
            out.append((lang, i + 1, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus(seed, docs=120):
    r = random.Random(seed)
    words = [w + str(i) for i in range(60) for w in ("a", "B", "ß")]
    weight = [1 / (i + 1) for i in range(len(words))]
    fixed = [" ".join(r.choices(words, k=4)) for _ in range(12)]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(r.randint(0, 40)):
            parts.append(r.choice(fixed) if r.random() < 0.2 else " ".join(r.choices(words, weight, k=r.randint(1, 9))))
        text = "".join(p + r.choice([". ", ", ", " ", "\t", "\n", "  ", "!?"]) for p in parts)
        rows.append((r.choice(["en", "en", "en", None, "und", "de"]), text))
    return rows + [("en", None), ("fr", ""), ("fr", "."), ("x y", " z z\tz z z z z z z z z z z ")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "rank int, text string, lang string, f int").repartition(3)
    return sorted(map(tuple, collocations.collocations(df, **kw).collect()))


@pytest.mark.parametrize("first", [3, 25, 2000])
def test_brute_force(spark, first):
    rows = corpus(first)
    expected = brute(rows, first=first)
    assert len(expected) > 5 and run(spark, rows, first=first) == expected


@pytest.mark.parametrize("size", [1, 7, 60])
def test_long_texts(spark, monkeypatch, size):
    # every text is cut into parts of about ``size`` bytes
    monkeypatch.setattr(collocations, "SLICE_BYTES", size)
    rows = corpus(5, 25) * 4
    expected = brute(rows, first=10)
    got = Counter()
    for lang, text in rows:
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text]), "lang": pa.array([5])})
        for data, offsets, langs, own in collocations._chunks(batch):
            key, piece, here, _, _ = collocations._keys(data, offsets, langs, own)
            got.update(tuple(key[i : i + 3]) for i in range(min(here, len(key) - 2)) if piece[i] == piece[i + 2])
    monkeypatch.undo()
    whole = Counter()
    for lang, text in rows:
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text]), "lang": pa.array([5])})
        for data, offsets, langs, own in collocations._chunks(batch):
            key, piece, _, _, _ = collocations._keys(data, offsets, langs, own)
            whole.update(tuple(key[i : i + 3]) for i in range(len(key) - 2) if piece[i] == piece[i + 2])
    assert got == whole and expected


def test_threshold_falls_until_enough_survive(spark):
    # the best pairs all lie inside triples, so the first threshold leaves too few
    rows = [("en", "\n".join(f"x{i} y{i} z{i}" for i in range(30))) for _ in range(10)]
    rows += [("en", "\n".join(f"p{i} q{i}\np{i}" for i in range(20))) for _ in range(11)]
    for first in (5, 31, 45):
        assert run(spark, rows, first=first) == brute(rows, first=first)


def test_ties_at_the_last_rank(spark):
    rows = [("en", "\n".join(f"x{i} y{i}" for i in range(50))) for _ in range(10)]
    got = run(spark, rows, first=7)
    assert got == brute(rows, first=7) and len(got) == 7


def test_exact_beyond_64_bits(spark):
    a, l, r = 999_999_999_999_989, 999_999_999_999_999_877, 999_999_999_999_989
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(score("a", "l", "r"))
    assert df.first()[0] == 1000000 * a * a // (l * r)


def test_keys_agree_with_spark(spark):
    r = random.Random(1)
    rows = [(r.randrange(-(2**63), 2**63), r.randrange(-(2**63), 2**63)) for _ in range(50)]
    df = spark.createDataFrame(rows, "w1 long, w2 long").select("w1", "w2", pair_key("w1", "w2").alias("k"))
    got = df.collect()
    w1, w2, k = (np.array([x[i] for x in got], np.int64).view(np.uint64) for i in range(3))
    assert (collocations._pair_key(w1, w2) == k).all()
    assert collocations._known(_bits(df.select("k")), k).all()


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, ""), (None, "a b")]) == []
    with pytest.raises(ValueError):
        run(spark, [], words=4)


def test_counting_a_chunk_takes_bounded_memory():
    rng = np.random.default_rng(0)
    vocabulary = np.array([f"w{i:05d}" for i in range(30000)])
    texts = [" ".join(vocabulary[rng.integers(0, 30000, 2000)]) for _ in range(700)]
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(np.arange(700) % 4, pa.int64()), "text": texts})
    tracemalloc.start()
    for chunk in collocations._chunks(batch):
        collocations._summed(*collocations._words_and_pairs(*chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000  # 161 MB with slices of 4 MB
