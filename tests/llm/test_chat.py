from __future__ import annotations

import random

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from pathlore.llm import chat
from pathlore.llm.queries import QUERIES, SQL


def fold(events):
    """The final messages of a log, event by event."""
    state = {}
    for conv, turn, seq, kind, role, text in sorted(set(events), key=lambda e: (e[0], e[1], e[2], e[3] in ("edit", "regenerate"), e[4] or "", e[5] or "")):
        m = state.setdefault((conv, turn), ["", ""])
        m[0] = m[0] or role or ""
        m[1] = (text or "") if kind in ("edit", "regenerate") else m[1] + (text or "")
    return state


def test_fold(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 4)
    r = random.Random(3)
    events = []
    for conv in range(12):
        for turn in range(r.randint(1, 5)):
            for seq in range(r.randint(1, 25)):
                kind = r.choices(["delta", "edit", "regenerate", None], [12, 1, 1, 1])[0]
                text = r.choice([None, "", "a", "bc ", "<|turn|>", "é", "</s>"]) if kind != "regenerate" else r.choice(["", "new "])
                events.append((conv, turn, seq, kind, r.choice(["user", "assistant", None]), text))
    events += events[:40]  # delivered twice
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = chat.fold_events(df.withColumn("msg", F.struct("turn")).repartition(5))
    assert {(x.conv_id, x.msg.turn): [x.role, x.text] for x in got.collect()} == fold(events)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 3)
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "~0~1~2~", "~", "<~[", "", None, "a\nb\n", "😀é", "x" * 9000, "~~1<"]
    rows = [(7, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(None, 1, "user", "null id"), (8, None, None, "no turn"), (8, 1, "assistant", "b"), (8, 1, "assistant", "a"), (8, 1, "assistant", "a")]
    rows += [(9, 0, "sys\ntem<|text|>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("kind", F.lit("edit"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [tuple(t) for t in got[7].turns] == [(r, t or "") for _, _, r, t in rows[:11]]
    assert got[7].loss_text == "".join(t or "" for t in odd[1::2])
    assert got[7].formatted == "".join(s.text for s in got[7].segments)
    assert got[7].formatted.count(chat.OPEN) == got[7].formatted.count("</s>") == len(odd) and "[INST]" not in got[7].formatted
    assert got[8].turns[0].text == "no turn" and sorted(t.text for t in got[8].turns[1:]) == ["a", "a", "b"]
    assert [tuple(t) for t in got[9].turns] == [("sys\ntem<|text|>", "t")] and got[None].loss_text == ""
    assert chat.format_conversations(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert difference(got, duck(sf).sql(SQL[name]).df()) is None
