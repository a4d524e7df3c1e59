from __future__ import annotations

import pytest

from pathlore.llm.decontaminate import contaminated


def found(spark, docs, items, **kw):
    """(doc, item) -> (matched, words, exact)."""
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {tuple(r)[:2]: tuple(r)[2:] for r in contaminated(df, bench, **kw).collect()}


def test_edited_passage_at_every_offset(spark):
    words = [f"plain{chr(97 + i)}" for i in range(20)]
    edited = ["changed" if i % 9 == 8 else w for i, w in enumerate(words)]
    docs = ["x " * before + " ".join(edited) + " y y" for before in range(4)]
    assert found(spark, docs, [" ".join(words)]) == {(k, 0): (18, 20, True) for k in range(4)}


def test_both_parts_around_an_inserted_word(spark):
    """A run of exactly one window behind an inserted word counts wherever it stands."""
    item = "the quick brown fox jumps over a lazy dog while seven old wizards quietly drink their tea"
    docs = ["x " * before + item.replace("dog", "dog hmm") for before in range(4)]
    assert found(spark, docs, [item]) == {(k, 0): (17, 17, True) for k in range(4)}


POOR = [
    "What is 12 + 30?",
    "Compute 3 + 4 * 12 - 7 / 2 and then 8 * 9 - 1",
    "PART ONE: NAME THE LARGEST PLANET OF THE SOLAR SYSTEM AND ITS MOONS",
    "Ada Lovelace, Alan Turing, Grace Hopper, Edsger Dijkstra, Barbara Liskov",
    "12 13 14 15 16 17 18 19 20 21 22 23",
    "Is water wet at night",
    "Minutes pass slowly when nobody speaks",
    "- Which river crosses the old town of our small country today",
]


@pytest.mark.parametrize("before", ["", "see below ", "an unpunctuated line\n", "Number 7 ", "It ended. "])
def test_verbatim_copies_of_any_item(spark, before):
    got = found(spark, [before + item + " and so on" for item in POOR], POOR)
    assert set(got) == {(i, i) for i in range(len(POOR))}
    assert all(matched == words and exact for matched, words, exact in got.values())


def test_placeholder_rich_windows_need_their_values(spark):
    docs = ["What is 15 + 40?", "1 2 3 4 5 6 7 8 9 10 11 12", "Mary Smith, John Brown, Anna Jones, Peter White, Lucy Black"]
    assert found(spark, docs, POOR) == {}
