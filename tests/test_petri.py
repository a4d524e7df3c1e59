from __future__ import annotations

import random
from collections import Counter, defaultdict, deque
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from pathlore.functions.ordered import SkewPolicy
from pathlore.operators import graph as G
from pathlore.operators import petri as N
from pathlore.operators.process import dfg


def log_of(spark, cases):
    rows = [(f"c{i:03d}", j, j, a) for i, c in enumerate(cases) for j, a in enumerate(c)]
    df = spark.createDataFrame(rows, "case_id string, event_id long, s int, activity string")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def alpha(cases):
    follow = {(a, b) for c in cases for a, b in zip(c, c[1:])}
    acts = sorted({a for c in cases for a in c})
    causal = {p for p in follow if p[::-1] not in follow}
    sets = [s for s in chain.from_iterable(combinations(acts, k) for k in range(1, len(acts) + 1)) if not any((a, b) in follow for a in s for b in s)]
    pairs = [(a, b) for a in sets for b in sets if all((x, y) in causal for x in a for y in b)]
    best = [p for p in pairs if not any(set(q[0]) >= set(p[0]) and set(q[1]) >= set(p[1]) and q != p for q in pairs)]
    net = {">".join("+".join(s) for s in p): p for p in best}
    return net | {"start": ((), tuple(sorted({c[0] for c in cases}))), "end": (tuple(sorted({c[-1] for c in cases})), ())}


def replay(case, net):
    held, p, c, m = Counter(start=1), 1, 0, 0
    for event in [*case, None]:
        for place, (gives, takes) in net.items():
            if event in takes or (event is None and place == "end"):
                c += 1
                m += held[place] == 0
                held[place] = max(0, held[place] - 1)
        for place, (gives, takes) in net.items():
            if event in gives:
                p += 1
                held[place] += 1
    r = sum(held.values())
    return p, c, m, r, 1 - m / c / 2 - r / p / 2


CLASSIC = ["abcd", "acbd", "aed", "abcd"]
LOGS = [CLASSIC, ["abcefbdc", "abcefbdc", "abdceg", "abdcefbcdbdceg"], ["a", "ab", "b"], ["aab", "ab"], ["xyz", "xz", "yxz", "zzy"]]


@pytest.mark.parametrize("cases", LOGS)
@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(2, 2)])
def test_alpha_and_replay(spark, cases, policy):
    log = log_of(spark, cases)
    net = N.alpha_net(dfg(log), N.case_ends(log, policy))
    got = {r.place: (tuple(r.inputs), tuple(r.outputs)) for r in net.collect()}
    assert got == alpha(cases)
    other = [*cases, "ba", "dcba", "q", "abcdabcd"]
    rows = N.token_replay(log_of(spark, other), net, policy).orderBy("case_id").collect()
    assert [tuple(r)[1:5] for r in rows] == [replay(c, got)[:4] for c in other]
    assert [r.fitness for r in rows] == pytest.approx([replay(c, got)[4] for c in other])


def test_classic_net_fits(spark):
    log = log_of(spark, CLASSIC)
    net = N.alpha_net(dfg(log), N.case_ends(log))
    assert {r.place for r in net.collect()} == {"start", "end", "a>b+e", "a>c+e", "b+e>d", "c+e>d"}
    one = N.replay_fitness(log, net).first()
    assert (one.missing, one.remaining, one.fitness, one.fit_cases) == (0, 0, 1.0, 1.0)


def betweenness(edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    out = Counter({e: 0.0 for e in edges})
    for s in near:
        dist, paths, order = {s: 0}, Counter({s: 1}), []
        todo = deque([s])
        while todo:
            u = todo.popleft()
            order.append(u)
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        due = Counter()
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    f = paths[u] / paths[v] * (1 + due[v])
                    due[u] += f
                    out[min(u, v), max(u, v)] += f / 2
    return out


def parts(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


def newman(edges, splits):
    nodes, edges = {n for e in edges for n in e}, sorted(edges)
    label = parts(nodes, edges)
    out, level, count = [(0, n, c) for n, c in label.items()], 0, len(set(label.values()))
    while edges and level < splits:
        b = betweenness(edges)
        edges.remove(min(edges, key=lambda e: (-round(b[e], 9), e)))
        label = parts(nodes, edges)
        if len(set(label.values())) > count:
            level, count = level + 1, len(set(label.values()))
            out += [(level, n, c) for n, c in label.items()]
    return out


def test_girvan_newman(spark):
    r = random.Random(3)
    graphs = {}
    for g in range(6):
        n = r.randint(2, 9)
        graphs[g] = {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(1, 14))}
    rows = [(g, u, v) for g, e in graphs.items() for u, v in e]
    df = spark.createDataFrame(rows + [(0, 5, 5)] + rows[:3], "graph long, u long, v long")
    got = {(x.graph, x.u, x.v): x.betweenness for x in G.edge_betweenness(df).collect()}
    assert got == pytest.approx({(g, *e): b for g, es in graphs.items() for e, b in betweenness(es).items()})
    for splits in (2,):
        found = sorted(tuple(x) for x in G.girvan_newman(df, splits).collect())
        assert found == sorted((g, *row) for g, es in graphs.items() for row in newman(es, splits))


def test_empty(spark):
    df = spark.createDataFrame([], "graph long, u long, v long")
    assert G.edge_betweenness(df).count() == 0 and G.girvan_newman(df).count() == 0
    log = log_of(spark, [])
    assert N.token_replay(log, N.alpha_net(dfg(log), N.case_ends(log))).count() == 0
