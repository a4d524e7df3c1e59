from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pathlore.llm.lm_score import Pieces, lattice, score_texts

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
def held_rows():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0



def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def spelled(model, weight):
    """Piece strings with their weights, first and further, read from the model by another way."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = Pieces(model)
    first, rest = [b""], []
    names = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
    first = [n[1:].encode() for n in names if n.startswith("▁") and "▁" not in n[1:]]
    rest = [n.encode() for n in names if "▁" not in n]
    rest += [bytes([b]) for b in range(256) if bytes([b]) not in set(rest)]
    assert len(first) == pieces.heads and len(first) + len(rest) + 1 == pieces.size
    return dict(zip(first, weight)), dict(zip(rest, weight[len(first) :]))


def brute(word, first, rest, stop):
    n = len(word)
    total = [0.0] * (n + 1)
    for end in range(n + 1):
        total[end] = first.get(word[:end], 0.0) + sum(total[b] * rest.get(word[b:end], 0.0) for b in range(end))
    return total[n] * stop


def test_lattice():
    pieces = Pieces(MODEL)
    weight = pieces.prior
    first, rest = spelled(MODEL, weight)
    words = [w.encode() for w in ("the", "ertion", "é", "a", "日本", "ouaux", "\x01x", "▁", "straße", "zzzzqqqq")]
    got = lattice(pieces, weight, np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    for w, g in zip(words, got):
        assert g == pytest.approx(math.log(brute(w, first, rest, weight[pieces.stop])), abs=1e-9)
    expected = np.zeros(pieces.size)
    lattice(pieces, weight, np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), expected)
    assert expected[: pieces.heads].sum() == pytest.approx(len(words))
    assert expected[pieces.stop] == pytest.approx(len(words))
    better = pieces.re_estimated(expected * 1000)
    assert lattice(pieces, better, np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])).sum() > got.sum()


def test_long_word():
    pieces = Pieces(MODEL)
    word = np.frombuffer(b"ab" * 4000, np.uint8)
    assert np.isfinite(lattice(pieces, pieces.prior, word, np.array([len(word)]))).all()


def test_scores(spark, sf, monkeypatch):
    from pathlore.llm import lm_score

    monkeypatch.setattr(lm_score, "GROUP_BYTES", 100_000)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 100_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "x" * 3000), (10_005, "The THE the é"), (10_005, "The THE the é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("held_out", F.lit(1))
    got = score_texts(df.drop("held_out", "id"), held_rows(), MODEL).collect()
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i, zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(t)) + 1, sum(counts[w] > 0 for w in [*tokens(t), None]), n,
         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*tokens(t), None]), 6))
        for i, t in rows
    )
    assert sorted((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = sum(r.score for r in got if r.held_out)
    untrained = score_texts(df.drop("held_out", "id"), held_rows(), MODEL, rounds=0).where("held_out").agg(F.sum("score")).first()[0]
    assert held > untrained + 0.01 * abs(untrained)
    assert score_texts(df.where("false"), held_rows(), MODEL).count() == 0


def expected_pieces(counts, first, rest, stop):
    """Expected uses of every piece, by sums over all places of a word."""
    heads, more = Counter(), Counter()
    for word, c in counts.items():
        n = len(word)
        left, right = [0.0] * (n + 1), [0.0] * (n + 1)
        right[n] = stop
        for end in range(n + 1):
            left[end] = first.get(word[:end], 0.0) + sum(left[b] * rest.get(word[b:end], 0.0) for b in range(end))
        for at in range(n - 1, -1, -1):
            right[at] = sum(rest.get(word[at:e], 0.0) * right[e] for e in range(at + 1, n + 1))
        z = left[n] * stop
        for end in range(n + 1):
            heads[word[:end]] += c * first.get(word[:end], 0.0) * right[end] / z
            for b in range(end):
                more[word[b:end]] += c * left[b] * rest.get(word[b:end], 0.0) * right[end] / z
    return heads, more


@pytest.mark.parametrize("rounds", [0, 2])
def test_score_is_the_marginal(spark, rounds):
    """Known and new words alike: all segmentations, with weights learned from the training tokens."""
    rows = [(1, "the the cat, sat"), (2, "The cat ate straße"), (3, "new catty words 日本"), (4, ""), (5, None), (6, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("doc_id").isin(3, 6), MODEL, rounds=rounds).collect()}
    counts = Counter(w for i, t in rows if i not in (3, 6) for w in tokens(t))
    pieces = Pieces(MODEL)
    first, rest = spelled(MODEL, pieces.prior)
    stop = pieces.prior[pieces.stop]
    prior_first, prior_rest, prior_stop = first, rest, stop
    for _ in range(rounds):
        heads, more = expected_pieces(counts, first, rest, stop)
        first = {p: heads[p] + 1000 * w for p, w in prior_first.items()}
        rest = {p: more[p] + 1000 * w for p, w in prior_rest.items()}
        stop = sum(counts.values()) + 1000 * prior_stop
        one, two = sum(first.values()), sum(rest.values()) + stop
        first, rest, stop = {p: w / one for p, w in first.items()}, {p: w / two for p, w in rest.items()}, stop / two
    end = (4 + 1) / (sum(counts.values()) + 4 + 100)
    for i, t in rows:
        want = sum(math.log10((1 - end) * brute(w, first, rest, stop)) for w in tokens(t)) + math.log10(end)
        assert got[i] == pytest.approx(want, abs=1e-8)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "a"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(df, F.lit(True), MODEL).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0 and got[1].score < got[2].score < 0
