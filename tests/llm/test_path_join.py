from __future__ import annotations

import random

import numpy as np
import pytest

from pathlore.llm import path_join
from pathlore.llm.path_join import near_duplicates, survival


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    if not ws:
        return set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, x) in enumerate(sets):
        for q, (j, y) in enumerate(sets[:p]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(p)] = find(q)
    least = {}
    for p, (i, _) in enumerate(sets):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    out = []
    for p, (i, x) in enumerate(sets):
        c = None if i is None else least[find(p)]
        out.append((i, len(x), c, None if i is None else c == i))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n int, node int, key string").repartition(4)
    return sorted(map(tuple, near_duplicates(df, **kw).collect()), key=str)


def families(seed, count=40, most=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, line = [], make(25)
    for _ in range(count):
        base = make(r.randint(3, 200))
        for _ in range(r.choice([1, 2, most])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.2:
                words = line + words
            rows.append(" ".join(words).upper() if r.random() < 0.1 else " \n".join(words))
    chain = make(200)
    for _ in range(20):
        chain = chain[4:] + make(4)
        rows.append(" ".join(chain))
    rows += [None, "", " \t", "one two", "one  two", "One two three four", "one two three four five"] + [rows[0]] * 30
    r.shuffle(rows)
    return list(zip(r.sample(range(10_000), len(rows)), rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = families(seed)
    assert run(spark, rows) == brute(rows)


def test_other_threshold(spark):
    rows = families(3, 20)
    assert run(spark, rows, percent=70) == brute(rows, 70)


@pytest.mark.parametrize("depth", [6, 2])
def test_large_nodes(spark, monkeypatch, depth):
    # nodes of more than 6 sets are followed; a star of copies that link to their source only
    monkeypatch.setattr(path_join, "LEAF", 6)
    monkeypatch.setattr(path_join, "FEW", 2)
    monkeypatch.setattr(path_join, "DEPTH", depth)
    r = random.Random(4)
    base = [f"b{r.random()}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(4):
            words[r.randrange(300)] = f"x{r.random()}"
        rows.append((i + 10, " ".join(words)))
    rows.append((500, " ".join(base)))
    rows += [(1000 + i, t) for i, t in families(5, 3)]
    assert run(spark, rows, trees=6) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (5, "x y"), (3, "A B C"), (7, "x y"), (8, "x\xa0y"), (9, "long " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_survival():
    # branching process by simulation
    r = np.random.default_rng(0)
    for depth in (1, 3, 8):
        alive = 0
        for _ in range(4000):
            now = 1
            for _ in range(depth):
                now = min(50, int((r.random(now) < 0.85).sum() + ((r.random(now) < 1 / 0.85 - 1) & (r.random(now) < 0.85)).sum()))
            alive += now > 0
        assert abs(alive / 4000 - survival(depth, 85)) < 0.03


def test_merged_labels(spark):
    from pathlore.llm.components import components, merged

    r = random.Random(9)
    first = [(r.randrange(300), r.randrange(300)) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components(frame(first))
    name = dict(map(tuple, labels.collect()))
    more = [(r.randrange(300), r.randrange(300)) for _ in range(80)]
    between = [(name.get(a, a), name.get(b, b)) for a, b in more]
    want = dict(map(tuple, components(frame(first + more)).collect()))
    got = dict(map(tuple, merged(labels, frame(between)).collect()))
    assert {k: got.get(k, k) for k in want} == want and all(want.get(k, k) == v for k, v in got.items())


def test_small_nodes_of_the_same_sets_are_opened_once(spark):
    rows = [(node, key, 5, key) for node in (1, 2, 9) for key in (10, 11)]
    rows += [(3, key, 5, key) for key in (10, 11, 12)] + [(4, 20, 5, 1), (4, 21, 5, 1)]
    rows += [(node, key, path_join.GRAMS, key) for node in (5, 6) for key in range(30, 40)]  # large: followed along different ways
    held, large = path_join._open(spark.createDataFrame(rows, "node long, key long, n long, label long"), len(rows))
    assert sorted((r.node, r.key) for r in held.where("small").collect()) == [(1, 10), (1, 11), (3, 10), (3, 11), (3, 12)]
    assert sorted(r.node for r in held.where("not small").collect()) == [5] * 10 + [6] * 10
    assert sorted((r.node, r.sets, r.grams) for r in large.collect()) == [(n, 10, 10 * path_join.GRAMS) for n in (5, 6)]
