"""SentencePiece encoding and decoding with the byte span of every piece in the original text.

A text is normalised by the model's own rules: at each position the longest key of the compiled
character map is replaced, and the source byte of every normalised byte is recorded. The
normalised text is cut where no piece of the vocabulary can reach across (in front of a run of
space marks, around characters that no longer piece contains), so each distinct segment is
encoded once per worker and its pieces are laid over the source by the recorded alignment.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathlore.llm.spans import row_slices

MARK = "▁"  # the vocabulary's space
SLICE_BYTES = 400_000  # text encoded at once
CACHE_BYTES = 24_000_000  # of the distinct segments a worker keeps
ENTRY_BYTES = 150  # of a segment beside its text and pieces


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        elif tag & 7 == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Keys and replacements of a compiled character map: a double-array trie and its strings."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    strings = blob[4 + size :]
    step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out, todo = {}, [(step(units[0]), b"")]
    while todo:
        node, key = todo.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            child, longer = at ^ step(units[at]), key + bytes([byte])
            if units[at] >> 8 & 1:
                begin = units[child] & 0x7FFFFFFF
                out[longer] = strings[begin : strings.index(b"\0", begin)]
            todo.append((child, longer))
    return out


class Normaliser:
    """Text to normalised text and the source byte of every normalised byte (and of its end)."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = character_map(fields.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(fields.get(n, 1)) for n in (3, 4, 5))
        keys = sorted(self.map, key=len, reverse=True)  # alternatives in this order give the longest key
        self.key = re.compile(b"|".join(map(re.escape, keys))) if keys else None

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at = [], [], 0

        def copy(lo: int, hi: int) -> None:
            out.append(text[lo:hi])
            source.append(np.arange(lo, hi, dtype=np.int32))

        for found in self.key.finditer(text) if self.key else ():
            copy(at, found.start())
            new = self.map[found.group()]
            out.append(new)
            source.append(np.full(len(new), found.start(), dtype=np.int32))
            at = found.end()
        copy(at, len(text))
        body, source = b"".join(out), np.concatenate(source)
        if self.trim:
            keep = np.frombuffer(body, np.uint8) != 32
            keep[1:] |= keep[:-1].copy()  # the first space behind a word stays
            keep &= np.cumsum(np.frombuffer(body, np.uint8) != 32) > 0
            last = np.flatnonzero(np.frombuffer(body, np.uint8) != 32)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            body, source = np.frombuffer(body, np.uint8)[keep].tobytes(), source[keep]
        if not body:
            return b"", np.array([len(text)], dtype=np.int32)
        if self.dummy:
            body, source = b" " + body, np.append(source[0], source)
        if self.escape:
            wide = np.where(np.frombuffer(body, np.uint8) == 32, 3, 1)
            body, source = body.replace(b" ", MARK.encode()), np.repeat(source, wide)
        return body, np.append(source, np.int32(len(text)))


class Codec:
    """A model's vocabulary, its normaliser and the segments encoded so far."""

    def __init__(self, model: bytes):
        import sentencepiece

        spec = b"".join(v for n, v in _fields(model) if n == 3)
        self.normalise = Normaliser(spec)
        # the library gets segments that are normalised already: the appended message switches its own rules off
        off = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(off)]) + off)
        plain = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        special = lambda i: self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i)
        self.piece = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(plain)
        ]
        self.width = [1 if self.library.is_byte(i) else len(p.encode()) for i, p in enumerate(plain)]
        self.unknown = self.library.unk_id()
        joined = {p for i, p in enumerate(plain) if len(p) > 1 and not special(i)}
        inner = {p for p in joined if MARK in p.lstrip(MARK)}
        if inner:
            raise ValueError(f"pieces with a space mark inside, such as {min(inner)!r}, can't be cut at spaces")
        self.alone = "".join(c for c in "\n\t" if not any(c in p for p in joined))
        alone = re.escape(self.alone)
        self.segment = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.widths, self.first, self.shown = array("i"), array("i"), array("q", [0]), []
        self.held = 0  # bytes, roughly

    def learn(self, segments: list[str]) -> None:
        for segment, ids in zip(segments, self.library.encode(segments, num_threads=1)):
            self.ids.extend(ids)
            if self.unknown in ids:
                surfaces = self.library.encode(segment, out_type=str)
                self.widths.extend(len(s.encode()) if i == self.unknown else self.width[i] for i, s in zip(ids, surfaces))
            else:
                self.widths.extend([self.width[i] for i in ids])
            self.first.append(len(self.ids))
            self.shown.append(b"".join([self.piece[i] for i in ids]))
            self.held += ENTRY_BYTES + 3 * len(segment) + 8 * len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Ids, first and last source bytes, pieces per text (offsets), and the texts decoded."""
        if self.held > CACHE_BYTES:
            self.reset()
        codes, counts, ends, aligned = [], [], [], []
        for text in texts:
            body, source = self.normalise(text.encode())
            segments = self.segment.findall(body.decode())
            codes += segments
            counts.append(len(segments))
            aligned.append(source)
        known = self.code
        new = [s for s in dict.fromkeys(codes) if s not in known]
        for s in new:
            known[s] = len(known)
        self.learn(new)
        codes = np.fromiter(map(known.__getitem__, codes), np.int64, len(codes))
        first = np.frombuffer(self.first, dtype=np.int64)
        ids, widths = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.widths, dtype=np.int32)
        size = first[codes + 1] - first[codes]
        place = np.repeat(first[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        edges = np.append(0, np.cumsum(counts))
        offsets = np.append(0, np.cumsum(size))[edges]
        width = widths[place].astype(np.int64)
        end = np.cumsum(width)
        begin = end - width
        start_of = np.append(0, end)[offsets]  # normalised bytes in front of each text
        shift = np.cumsum([0] + [len(a) for a in aligned])
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        source = np.concatenate(aligned) if aligned else np.empty(0, np.int32)
        begin, end = (source[x - start_of[row] + shift[row]] for x in (begin, end))
        shown, listed, decoded = self.shown, codes.tolist(), []
        for i in range(len(texts)):
            whole = b"".join([shown[c] for c in listed[edges[i] : edges[i + 1]]])
            decoded.append(whole[1:] if self.normalise.dummy and whole[:1] == b" " else whole)
        return ids[place], begin, end, offsets, decoded


_CODECS: dict[int, Codec] = {}


def encode(documents: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, ids, begins, ends, decoded, ``carry``) per row of ``documents``.

    ``model`` is a serialised SentencePiece model. ``ids`` is what the library gives for the whole
    text without begin or end ids; ``begins`` and ``ends`` are the byte range of the UTF-8 text
    that each piece stands for (the added leading space stands for none, a byte piece for its
    byte, a replaced string for the whole string it came from); ``decoded`` is the text of the
    ids. Null and empty texts give empty lists and an empty text; a null id stays null; repeated
    rows are encoded each. Columns not named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(model)
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(model)
        codec = _CODECS[key]
        for batch in batches:
            for lo, hi in row_slices(batch.column(text_col), SLICE_BYTES):
                texts = [t or "" for t in batch.column(text_col).slice(lo, hi - lo).to_pylist()]
                ids, begin, end, offsets, decoded = codec.encode(texts)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begin, end)]
                part = batch.slice(lo, hi - lo)
                columns = {id_col: part.column(id_col), "ids": lists[0], "begins": lists[1], "ends": lists[2]}
                columns["decoded"] = pa.array(decoded, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns | {c: part.column(c) for c in carry})
            pa.default_memory_pool().release_unused()

    kinds = dict(documents.dtypes)
    schema = [f"`{id_col}` {kinds[id_col]}", "ids array<int>", "begins array<int>", "ends array<int>", "decoded string"]
    schema += [f"`{c}` {kinds[c]}" for c in carry]
    return documents.select(*dict.fromkeys([id_col, text_col, *carry])).mapInArrow(run, ", ".join(schema))
