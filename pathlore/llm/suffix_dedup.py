"""Removal of repeated byte strings: a column-wise suffix order of a collection of strings.

The collection Burrows-Wheeler transform is built by inserting one symbol per string in every
round, from the last symbol to the first, together with the longest common prefix of each suffix
and the one before it. Strings whose suffixes share ``window`` bytes stand next to each other in
the end. ``repeats`` splits the corpus into buckets so that equal windows meet; strings there have
at most ``2 * window - gram`` bytes, which bounds the rounds, and a bucket's columns are arrays in
memory, not files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathlore.llm.repeats import covered, repeated_windows
from pathlore.llm.spans import BYTE_HASH, Texts, ngram_hash

WINDOW = 50  # bytes
GRAM = 20  # bytes hashed to a minimiser
COLLECTION_BYTES = 250_000  # strings ordered at once; their columns then stay in a processor's cache


def collection_suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: (string, start, common prefix with the one before, BWT symbol).

    The symbol is -1 in front of a whole string. Equal suffixes stand in the order of their
    strings' tails, empty suffixes first.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    # symbols are counted from 1, 0 stands in front of a whole string; one byte sorts faster than two
    kind = np.uint8 if data.max(initial=0) < 255 else np.uint16
    data = data.astype(kind) + kind(1)
    base = np.cumsum(sizes) - sizes
    total = len(strings)

    def before(string: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The symbol in front of each suffix."""
        out = np.zeros(len(string), dtype=kind)
        inner = start > 0
        out[inner] = data[base[string[inner]] + start[inner] - 1]
        return out

    string, start = np.arange(total, dtype=np.int32), sizes.astype(np.int32)
    bwt, lcp, new = before(string, start), np.zeros(total, dtype=np.int32), np.ones(total, dtype=bool)
    for _ in range(int(sizes.max(initial=0))):
        # occurrences of symbols in BWT order are the non-empty suffixes in order (LF mapping)
        at = np.flatnonzero(bwt)
        at = at[np.argsort(bwt[at], kind="stable")]
        symbol, fresh = bwt[at], new[at]
        if not fresh.any():
            break
        place = total + np.flatnonzero(fresh)
        rest = np.ones(total + len(at), dtype=bool)
        rest[place] = False
        grown_string, grown_start = np.empty(len(rest), np.int32), np.empty(len(rest), np.int32)
        grown_bwt, grown_lcp = np.empty(len(rest), kind), np.empty(len(rest), np.int32)
        grown_string[rest], grown_start[rest], grown_bwt[rest], grown_lcp[rest] = string, start, bwt, lcp
        source = at[fresh]
        grown_string[place], grown_start[place] = string[source], start[source] - 1
        grown_bwt[place] = before(grown_string[place], grown_start[place])
        # common prefixes change at inserted suffixes and right behind them
        touched = fresh.copy()
        touched[1:] |= fresh[:-1]
        t = np.flatnonzero(touched)
        alike = np.zeros(len(t), dtype=bool)
        alike[t > 0] = symbol[t[t > 0]] == symbol[t[t > 0] - 1]
        grown_lcp[total + t] = 0
        t = t[alike]
        if len(t):
            ranges = np.column_stack([at[t - 1] + 1, at[t] + 1]).reshape(-1)
            grown_lcp[total + t] = 1 + np.minimum.reduceat(np.append(lcp, 0), ranges)[::2]
        string, start, bwt, lcp = grown_string, grown_start, grown_bwt, grown_lcp
        new = ~rest
    return string, start, lcp, bwt.astype(np.int16) - 1


def shared_windows(strings: list[bytes], ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that also lies in a string with a smaller id."""
    string, start, lcp, _ = collection_suffixes(strings)
    owner = np.asarray(ids)[string]
    heads = np.flatnonzero(lcp < window)
    first = np.minimum.reduceat(owner, heads)
    first = np.repeat(first, np.diff(np.append(heads, len(owner))))
    size = np.array([len(s) for s in strings], dtype=np.int64)[string]
    late = np.flatnonzero((size - start >= window) & (owner > first))
    return string[late].astype(np.int64), start[late].astype(np.int64)


def _touching(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings with a window whose hash occurs again, and the range that holds all such windows.

    Equal windows have equal hashes, so what is left out shares no window with any string.
    """
    size = np.array([len(s) for s in strings], dtype=np.int64)
    end = np.cumsum(size)
    h = ngram_hash(BYTE_HASH[np.frombuffer(b"".join(strings), dtype=np.uint8)], window)
    at = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(end, size)[: len(h)])
    order = np.argsort(h[at], kind="stable")
    same = h[at][order][1:] == h[at][order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = at[again]
    owner = np.searchsorted(end, at, side="right")
    which, first = np.unique(owner, return_index=True)
    last = np.append(first, len(at))[1:] - 1
    begin = end[which] - size[which]
    return which, at[first] - begin, at[last] - begin + window


def settle_collections(
    strings: list[bytes], value: np.ndarray, ids: np.ndarray, window: int, most: int = COLLECTION_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """``shared_windows`` over collections of whole minimiser classes of about ``most`` bytes."""
    which, begin, end = _touching(strings, window)
    strings = [strings[n][b:e] for n, b, e in zip(which.tolist(), begin.tolist(), end.tolist())]
    value, ids = value[which], ids[which]
    order = np.argsort(value, kind="stable")
    ends = np.append(np.flatnonzero(value[order][1:] != value[order][:-1]) + 1, len(order))
    size = np.cumsum([len(strings[i]) for i in order])
    found, lo = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while lo < len(order):
        reach = np.searchsorted(size, (size[lo - 1] if lo else 0) + most)
        hi = int(ends[max(np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, reach, side="right") - 1)])
        mine = order[lo:hi]
        own, at = shared_windows([strings[i] for i in mine], ids[mine], window)
        found.append((which[mine[own]], at + begin[mine[own]]))
        lo = hi
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def drop_repeated_bytes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, spans, kept, ``carry``) per row of ``documents``.

    Texts are their UTF-8 bytes. Every byte is removed that lies in a string of ``window`` bytes
    that also starts in a text with a smaller id; strings are judged on the input. ``spans`` holds
    the removed ranges (start, end), ``kept`` the other bytes, which need not be valid UTF-8.

    Null and short texts stay whole; a null text is empty. A null id counts as larger than any
    other. Rows that share an id don't remove each other. Columns not named are not read.
    """

    def settle(strings, value, ids, start):
        return settle_collections(strings, value, ids, window)

    def finish(table: pa.Table, texts: Texts, gone: dict) -> pa.Table:
        at = texts.offsets[gone["row"]] + gone["start"]
        mask = covered(len(texts.data), at, at + gone["count"] + window - 1)
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        cut = np.zeros(len(mask) + 1, dtype=bool)  # a range ends where its text ends
        cut[texts.offsets[1:-1]] = True
        inner = cut[1:-1] & mask[1:] & mask[:-1] if len(mask) else np.empty(0, bool)
        begin = np.union1d(np.flatnonzero(edge > 0), np.flatnonzero(inner) + 1)
        end = np.union1d(np.flatnonzero(edge < 0), np.flatnonzero(inner) + 1)
        row = np.searchsorted(texts.offsets, begin, side="right") - 1
        per_row = np.bincount(row, minlength=len(table))
        total = np.append(0, np.cumsum(mask))
        n_removed = total[texts.offsets[1:]] - total[texts.offsets[:-1]]
        kept_offsets = texts.offsets - total[texts.offsets]
        kept = texts.data[~mask]
        edges = pa.array(np.append(0, np.cumsum(per_row)), pa.int32())
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - texts.offsets[row]), pa.array(end - texts.offsets[row])], names=["start", "end"]
        )
        columns = {
            id_col: table.column(id_col),
            "n_bytes": pa.array(np.diff(texts.offsets)),
            "n_removed": pa.array(n_removed.astype(np.int64)),
            "n_spans": pa.array(per_row.astype(np.int64)),
            "spans": pa.ListArray.from_arrays(edges, spans),
            "kept": pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(table), [None, pa.py_buffer(kept_offsets.astype(np.int64)), pa.py_buffer(kept)]
            ).cast(pa.binary()),
        }
        return pa.table(columns | {c: table.column(c) for c in carry})

    kinds = dict(documents.dtypes)
    schema = ", ".join(
        [f"`{id_col}` long", "n_bytes long", "n_removed long", "n_spans long", "spans array<struct<start: long, end: long>>", "kept binary"]
        + [f"`{c}` {kinds[c]}" for c in carry]
    )
    return repeated_windows(documents, "bytes", window, gram, settle, finish, schema, id_col, text_col, carry=carry)
