from __future__ import annotations

import random

from pathlore.llm.url_filter import filter_urls

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("a.net", "/es/pre", "allow"), ("org", "", "block"), ("b.org", "/x/y/z/", "allow"), ("com", "/", "block"), ("q.com", "/same/", "block"),
    ("com", "/same/qq", "allow"), (None, "/", "block"), ("x.com", None, "block"), ("net", "/es/", "block"),
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = {}
    for h, p, v in RULES:
        if h and p is not None:
            rules[h.lower(), p] = max(rules.get((h.lower(), p), ""), v)
    best = max(((len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_rules(spark):
    r = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "a.net", "b.a.net", "net", "c.b.org", "b.org", "", "x.q.com", "É.com", "..com", "com"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/es/pre", "/es/prefix/", "/x/y/z/", "/x/y/z", "//en/", "/same/qq", "/same/"]
    urls = [f"{r.choice(['http', 'https', '', 'a://b'])}://{h}{p}{r.choice(['', '?q=/en/', '#f', '?a#b', '#a?b'])}" for h in hosts for p in paths]
    urls += [None, "", "example.com/en/", "http:/x", "://net/es/", "http://a\nb.net/es/\nx", "http://" + "a." * 800 + "net/es/" + "y/" * 3000, urls[0], urls[0]]
    pages = spark.createDataFrame([(i % 40 if i % 7 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    pages = pages.union(pages.limit(30))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, map(tuple, filter_urls(pages, rules).collect())))
    want = sorted(str((i, *judge(u))) for i, u in pages.select("page_id", "url").collect())
    assert got == want


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [tuple(r) for r in filter_urls(pages, rules.where("false")).collect()] == [(1, "a.com", "/", None, "allow")]
    assert filter_urls(pages.where("false"), rules).count() == 0
