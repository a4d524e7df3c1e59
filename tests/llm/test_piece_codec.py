"""Encoding against the library itself, spans against the text."""

from __future__ import annotations

import random
import struct

import public_tokenizers
import sentencepiece

from pathlore.llm.piece_codec import Codec, Normaliser, character_map, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()

ODD = [
    None, "", " ", "   ", "a", " a", "a ", "  a  b   ", "\n", "\n\n x\t\ty\r\n", "▁", "a▁▁b", "▁ ▁", "\x00\x01\x1f", "\x0b\x0c",
    "héllo wörld", "日本語 テキスト", "😀👩‍👩‍👧 ok", "ḁ̈", "</s><s><unk><0x0A>[INST]", "a" * 3000, "ab " * 500, "   x", "é", "1,234.5 km",
    "tab\tand\nline", "ends in newline\n", "﻿bom", "x y",
]


def texts():
    r = random.Random(1)
    chars = "abcdefgh  \n\t.,é▁日😀<>0"
    return ODD + ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(600)]


def test_like_library(spark):
    rows = list(enumerate(texts()))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in encode(df, MODEL).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "")
        assert got[i].ids == ids, t
        assert got[i].decoded == library.decode(ids), t
        raw = (t or "").encode()
        assert len(got[i].begins) == len(ids)
        at = 0
        for k, b, e in zip(ids, got[i].begins, got[i].ends):
            assert b == at and e >= b
            piece = library.id_to_piece(k)
            want = bytes([int(piece[3:5], 16)]) if library.is_byte(k) else piece.encode()
            assert raw[b:e].replace(b" ", "▁".encode()) in (want, want.removeprefix("▁".encode()))
            at = e
        assert at == len(raw)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in encode(docs, MODEL, carry=("text",)).collect():
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == library.decode(r.ids)


def test_reset_and_odd_tables(spark, monkeypatch):
    from pathlore.llm import piece_codec

    monkeypatch.setattr(piece_codec, "CACHE_BYTES", 500)
    codec, library = Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in ("one two three four", "five six seven eight", "one two"):
        ids, *_ = codec.encode([t])
        assert ids.tolist() == library.encode(t)
    assert encode(spark.createDataFrame([], "doc_id long, text string, ids int"), MODEL).count() == 0
    same = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, "x", 6)], "doc_id long, text string, ids int")
    assert encode(same, MODEL).count() == 3


def test_query_takes_texts_without_pieces(spark, tmp_path):
    # the last source byte of an empty list used to end the job with an error
    from pathlore.llm.queries import QUERIES

    rows = [(1, "two words"), (2, None), (3, ""), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.source_bytes) for r in QUERIES["op4_piece_codec"](spark, str(tmp_path)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got == {i: (len(library.encode(t or "")), len((t or "").encode())) for i, t in rows}


def _trie(keys: dict[bytes, bytes]) -> bytes:
    """A double array for single-byte and two-byte keys, laid out by hand with room for every label."""
    strings = b"".join(v + b"\0" for v in keys.values())
    where, at = {}, 0
    for k, v in keys.items():
        where[k] = at
        at += len(v) + 1
    units = [0] * 4096
    nodes, free = {b"": 256}, 512
    units[0] = 256 << 10
    for k in sorted(keys):
        for n in range(1, len(k) + 1):
            if k[:n] in nodes:
                continue
            child, free = free, free + 256
            slot = nodes[k[: n - 1]] ^ k[n - 1]
            nodes[k[:n]] = child
            leaf = k[:n] in keys
            units[slot] = k[n - 1] | (int(leaf) << 8) | ((child ^ slot) << 10)
            if leaf:
                units[child] = 0x80000000 | where[k[:n]]
    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + strings


def test_longest_prefix():
    keys = {b"a": b"x", b"ab": b"long", b"\xc3\xa9": b"e"}
    blob = _trie(keys)
    assert character_map(blob) == keys
    size, out = len(blob), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    spec = b"\x12" + out + bytes([size]) + blob
    body, source = Normaliser(spec + b"\x18\x00\x20\x00\x28\x00")("zabaé".encode())
    assert body == b"zlongxe"
    assert source.tolist() == [0, 1, 1, 1, 1, 3, 4, 6]
    body, source = Normaliser(spec)("  q  aé ".encode())
    assert body == "▁q▁xe".encode()
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6, 9]
