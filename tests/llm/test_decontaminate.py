from __future__ import annotations

import re

import pytest

from pathlore.llm.decontaminate import UNITS, contaminated

QUESTION = "Last Monday Alice drove 120 km from Paris to Lyon in 3 hours and paid 45 dollars, how many dollars did each of the 3 hours cost her?"
ITEMS = [
    (1, QUESTION),
    (2, "the quick brown fox jumps over a lazy dog while seven old wizards quietly drink their tea"),
    (3, "is water wet at night"),
    (4, None),
    (5, ""),
    (6, "12 13 14 15 16 17 18 19 20 21 22 23"),
    (2, "the quick brown fox jumps over a lazy dog while seven old wizards quietly drink their tea"),
]
FILLER = "nothing here is of any interest to anyone who reads it so go on. "


def document(i):
    return {
        0: FILLER + QUESTION + " " + FILLER,
        1: FILLER + QUESTION.replace("120", "340").replace("3 hours", "5 hours").replace("Alice", "Bob").replace("45", "90"),
        2: FILLER + QUESTION.replace("in 3 hours", "in 5 hours"),  # the two 3 no longer agree; plain words still cover it
        3: FILLER * 3,
        4: "He said: the quick brown fox, jumps over a lazy dog while SEVEN old wizards quietly drink their tea!",
        5: "the quick brown fox jumps over something else entirely",
        6: "so is water wet at night or not",
        7: None,
        8: "",
        9: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18",
        10: "x " * 5000 + QUESTION + " y" * 5000,
        11: "the quick brown fox jumps over a lazy dog hmm while seven old wizards quietly drink their tea",
    }[i]


def template(text):
    text = re.sub(r"(?<=\d)(?=[^\W\d_])", " ", text or "")
    words = []
    previous = None
    for w in text.split():
        name = w[0].isupper() and previous is not None and previous[-1] not in ".!?:"
        plain = re.sub(r"[\W_]+", "", w.lower())
        unit = plain in UNITS and words and re.search(r"\d$", words[-1][1])
        if plain:
            words.append(("N" if name else "U" if unit else "#" if plain[0].isdigit() else plain, plain))
        previous = w
    return words


def brute(docs, items, coverage=0.5):
    """From the definition: shifts with an equal window, consistent values along each, places united."""
    out = set()
    for d, text in docs:
        mine = template(text)
        for k, item in items:
            theirs = template(item)
            n = len(theirs)
            sizes = {8} | {n} if n < 11 else {8}
            places, exact = set(), True
            for shift in range(-n, len(mine)):
                at = [i for i in range(n) if 0 <= shift + i < len(mine)]
                word = {i for i in at if mine[shift + i][0] == theirs[i][0]}
                value = {i for i in at if mine[shift + i][1] == theirs[i][1]}
                word |= value & {0}  # its kind depends on what stands before it

                def met(lo, size, word=word, value=value, theirs=theirs):
                    window = range(lo, lo + size)
                    plain = sum(theirs[j][0] not in "NU#" for j in window)
                    return word.issuperset(window) if plain >= min(4, size) else value.issuperset(window)

                if any(met(lo, size) for size in sizes if size for lo in range(n - size + 1)):
                    slots = {(theirs[i], mine[shift + i][1]) for i in word if theirs[i][0] in "NU#"}
                    exact &= all(t[1] == o for t, o in slots)
                    places |= {i for i in word if theirs[i][0] not in "NU#" or sum(s[0] == theirs[i] for s in slots) == 1}
            if n and places and len(places) >= coverage * n:
                out.add((d, k, len(places), n, exact))
    return out


def test_two_variants_in_one_text(spark):
    heavy = "In 1970 Tom Smith and Ann Jones sold 12 red and 30 blue apples for 45 dollars to 7 men in 8 days"
    other = heavy.replace("1970", "1980").replace("12", "55").replace("30", "31").replace("45", "46").replace("7 men", "9 men").replace("8 days", "2 days")
    third = other.replace("55", "56").replace("46", "99")
    docs = [(1, f"so it says: {heavy}"), (2, f"so it says: {other}"), (3, f"so it says: {other}. and then it goes on: {third}"), (4, f"a: {heavy}. b: {third}"), (5, f"a: {heavy}. b: {heavy}")]
    bench = spark.createDataFrame([(7, heavy)], "item_id long, text string")
    got = {tuple(r) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == brute(docs, [(7, heavy)])
    assert {(g[0], g[4]) for g in got} == {(1, True), (2, False), (3, False), (4, False), (5, True)}
    assert len({g[2] for g in got}) == 1


def test_planted(spark):
    docs = [(i, document(i)) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({})
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in contaminated(df, bench).collect()}
    assert got == brute(docs, ITEMS)
    pairs = {r[:2]: r[4] for r in got}
    assert pairs == {(0, 1): True, (1, 1): False, (2, 1): False, (4, 2): True, (6, 3): True, (10, 1): True, (11, 2): True} or pairs[(1, 1)] is False
    assert {k[0] for k in pairs} == {0, 1, 2, 4, 6, 10, 11}
    strict = {r.doc_id for r in contaminated(df, bench, coverage=0.95).collect()}
    assert 1 in strict and 2 not in strict


@pytest.mark.parametrize("empty", ["docs", "bench"])
def test_empty(spark, empty):
    df = spark.createDataFrame([(1, QUESTION, 1), (None, QUESTION, 1), (1, QUESTION, 1)], "doc_id int, text string, words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contaminated(df.where("false") if empty == "docs" else df, bench.where("false") if empty == "bench" else bench)
    assert out.count() == 0


def test_shared_ids(spark):
    df = spark.createDataFrame([(1, QUESTION, 1), (None, QUESTION, 1), (1, QUESTION, 1)], "doc_id int, text string, words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r)[:2] for r in contaminated(df, bench).collect()] == [(1, 1)]


def test_known_leaks(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = docs.select("doc_id", "text").collect(), bench.collect()
    planted = {(d.doc_id, b.item_id) for d in texts for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert planted <= got
    assert len(got - planted) <= 3


def test_words_are_made_once_per_text(spark):
    """They were made again for every place of an item that is compared."""
    text = "Please work out how many red apples the tall farmer sold at the market on that day"
    docs = spark.createDataFrame([(1, "so " + text), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    found = contaminated(docs, items)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
