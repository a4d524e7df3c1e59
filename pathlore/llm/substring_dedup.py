"""Removal of repeated word passages: super-k-mer partitioning and exact counting by sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathlore.llm.repeats import covered, repeated_windows
from pathlore.llm.spans import Texts, words

WINDOW = 20  # words
GRAM = 10  # words hashed to a minimiser


def count_windows(
    strings: list[bytes], value: np.ndarray, ids: np.ndarray, start: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Sorts all windows of a bucket; (string, offset) of every one behind the first of its kind."""
    rows = []
    for n, s in enumerate(strings):
        ends = np.append(np.flatnonzero(np.frombuffer(s, np.uint8) == 32), len(s)).tolist()
        begin = [0] + [e + 1 for e in ends[:-1]]
        doc, at = int(ids[n]), int(start[n])
        rows += [(s[begin[i] : ends[i + window - 1]], doc, at + i, n, i) for i in range(len(ends) - window + 1)]
    rows.sort()
    again, first = [], None
    for row in rows:
        if first is None or row[0] != first[0]:
            first = row
        elif row[1:3] > first[1:3]:
            again.append(row[3:])
    found = np.array(again, dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def drop_repeated_passages(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row (id, n_words, n_removed, kept, ``carry``) per row of ``documents``.

    Words are ``[^\\x20\\x09-\\x0D]+``. Every word is removed that lies in a window of ``window``
    words whose words also start earlier: in a text with a smaller id, or further left in the
    same text. Windows are judged on the input. ``kept`` is the other words joined by one space.

    Null text has no words. Texts of fewer than ``window`` words stay whole. A null id counts as
    larger than any other. Rows that share an id have no order, so for them only the place in
    the text counts: equal windows at equal places stay. Columns not named are not read.
    """

    def settle(strings, value, ids, start):
        return count_windows(strings, value, ids, start, window)

    def finish(table: pa.Table, texts: Texts, gone: dict) -> pa.Table:
        n = len(table)
        order = np.argsort(gone["row"], kind="stable")
        row, at, count = gone["row"][order], gone["start"][order], gone["count"][order]
        n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        raw = texts.data.tobytes()
        lo, hi = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")
        for i in range(n):
            own = raw[texts.offsets[i] : texts.offsets[i + 1]].split()
            n_words[i] = len(own)
            if hi[i] > lo[i]:
                s = slice(lo[i], hi[i])
                mask = covered(len(own), at[s], at[s] + count[s] + window - 1)
                n_removed[i] = mask.sum()
                own = [w for w, gone_word in zip(own, mask.tolist()) if not gone_word]
            kept.append(b" ".join(own))
        columns = {
            id_col: table.column(id_col),
            "n_words": pa.array(n_words),
            "n_removed": pa.array(n_removed),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        return pa.table(columns | {c: table.column(c) for c in carry})

    kinds = dict(documents.dtypes)
    schema = ", ".join([f"`{id_col}` long", "n_words long", "n_removed long", "kept string", *[f"`{c}` {kinds[c]}" for c in carry]])
    return repeated_windows(
        documents, "words", window, gram, settle, finish, schema, id_col, text_col, same_text=True, carry=carry
    )
