from __future__ import annotations

import random

import pytest

from pathlore.llm import ngram_join
from pathlore.llm.components import components
from pathlore.llm.ngram_join import near_duplicates


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    if not ws:
        return set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, x) in enumerate(sets):
        for j, y in sets[:p]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i is None, i or 0, len(x), None if i is None else find(i)) for i, x in sets), key=str)


def family_corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 300
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, license_line = [], make(30)
    for _ in range(40):
        base = make(r.randint(3, 150))
        for _ in range(r.choice([1, 1, 2, 8, 20])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:
                words = words[: int(len(words) * r.uniform(0.7, 1))]
            if r.random() < 0.3:
                words = license_line + words
            text = r.choice([" ", "\n", "  "]).join(words)
            rows.append(text.upper() if r.random() < 0.1 else text)
    chain = make(120)
    for i in range(30):  # neighbours link, far ones don't
        chain = chain[4:] + make(4)
        rows.append(" ".join(chain))
    rows += [None, "", " \n", "one two", "one  two", "One two three four", "one two three four five"] + [rows[0]] * 25
    r.shuffle(rows)
    return list(zip(r.sample(range(10_000), len(rows)), rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(ngram_join, "ROWS", 7)
    monkeypatch.setattr(ngram_join, "DENSE", (0, 4)[seed - 1])
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    rows = family_corpus(seed) + [(None, "one two"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_shared_ids_and_empty(spark):
    t = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(5, t[0], 1), (5, t[1], 1), (7, t[0], 1), (3, t[1], 1), (9, t[2], 1), (9, t[2], 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n int")
    assert sorted(r[2] for r in near_duplicates(df).collect()) == [3, 3, 5, 5, 9, 9]
    assert near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7)] + [(400, 400 + i) for i in range(1, 50)]
    df = spark.createDataFrame(links, "a long, b long")
    label = dict(map(tuple, components(df).collect()))
    assert {label[i] for i in range(61)} == {0}
    assert {label[i] for i in (100, 200, 300)} == {100} and {label[i] for i in range(400, 450)} == {400}
    assert components(df.where("false")).count() == 0
