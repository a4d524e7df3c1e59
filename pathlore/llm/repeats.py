"""Windows that repeat across a corpus: the shuffle shared by the suffix-array and super-k-mer operators.

A window is ``window`` consecutive units (bytes or words) of one text. Its minimiser is the
smallest hash of the ``gram``-unit strings inside it, so equal windows have equal minimisers.
Consecutive windows with the same minimiser occurrence form a run, at most ``window - gram + 1``
windows that travel as one string. Texts are hashed to groups of about ``GROUP_BYTES``; all steps
work on a group or a bucket:

1. every group sends the distinct minimisers of its runs (5 bytes each) to hash buckets, and the
   buckets answer with those seen twice: a run with any other minimiser holds no repeated window;
2. runs with a repeated minimiser go to the minimiser's bucket as strings. A string that a group
   holds many times is sent once, with its first occurrence; later ones are settled in the group.
   So a passage that a third of all texts share costs one string per group and not per text;
3. the bucket settles strings that are equal, and ``settle`` those that only share windows;
4. removed ranges go back to their group, which cuts its texts.

Hashes only route strings and drop runs that cannot repeat; windows are compared by content.
Groups, buckets and answers depend on the rows alone, so tasks that run again send the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.spans import BYTE_HASH, Texts, mix, ngram_hash, pack, sliding_min, unpack, words

GROUP_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000  # text bytes per bucket: even if everything repeats, a bucket gets about four times as many
SLICE_BYTES = 1_000_000  # bytes hashed at once
NO_ID = np.iinfo(np.int64).max  # a null id comes last

Settle = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def group_count(documents: DataFrame, text_col: str) -> tuple[int, int]:
    """Numbers of text groups and of minimiser bits of a bucket, from the bytes of all texts."""
    total = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // GROUP_BYTES)), max(0, int(total // BUCKET_BYTES).bit_length())


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return table.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _ordered(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, Texts]:
    """Rows by id, then text: the same order wherever the group is read."""
    ids = _ids(table, id_col)
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        text = table.column(text_col).to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i] or "")), dtype=np.int64)
    table = table.take(pa.array(order))
    return table, ids[order], Texts(table.column(text_col))


class _Runs:
    """Runs of one slice of texts: minimiser, row, start unit in the row's text, windows, bytes."""

    def __init__(self, texts: Texts, lo: int, hi: int, unit: str, window: int, gram: int):
        base = texts.offsets[lo]
        data, offsets = texts.data[base : texts.offsets[hi]], texts.offsets[lo : hi + 1] - base
        if unit == "bytes":
            from_byte, to_byte, first = None, None, offsets
            h = BYTE_HASH[data]
        else:
            from_byte, to_byte, first, h = words(data, offsets)
        grams = ngram_hash(h, gram)
        least = sliding_min(grams, window - gram + 1)
        end = np.repeat(first[1:], np.diff(first))[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + window <= end)
        value = least[at]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (grams[at[1:] - 1] == value[1:])
        begin = np.flatnonzero(cut)
        self.data = data
        self.value = value[begin]
        self.count = np.diff(np.append(begin, len(at)))
        unit_at = at[begin]
        row = np.searchsorted(first, unit_at, side="right") - 1
        self.row, self.start = row + lo, unit_at - first[row]
        last = unit_at + self.count + window - 2
        self.from_byte = unit_at if from_byte is None else from_byte[unit_at] if len(unit_at) else unit_at
        self.to_byte = last + 1 if to_byte is None else to_byte[last] if len(unit_at) else unit_at


def _keys(value: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` for the bucket and 40 more of a minimiser, mixed again as minima are small."""
    return mix(value) >> np.uint64(24 - bits)


def _five(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].copy().reshape(-1)


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _table(**columns: list) -> pa.Table:
    kinds = {"bucket": pa.int32(), "grp": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})


def repeated_windows(
    documents: DataFrame,
    unit: str,
    window: int,
    gram: int,
    settle: Settle,
    finish: Callable[[pa.Table, Texts, dict], pa.Table],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    same_text: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Applies ``finish`` to every group of texts and the windows to remove in it.

    A window is to be removed if an equal one starts in a text with a smaller id or, with
    ``same_text``, also if one starts earlier in a text of the same id. ``finish`` gets the rows
    (id, text, ``carry``), their texts and ``{"row", "start", "count"}``: ``count`` windows from
    ``start`` of row ``row``.
    """
    groups, bits = group_count(documents, text_col)
    docs = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), *[c for c in carry if c != text_col]).withColumn(
        "_grp", F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(groups)).cast("int")
    )
    by_group = docs.groupBy("_grp")

    def runs(texts: Texts):
        for lo, hi in texts.slices(SLICE_BYTES):
            yield _Runs(texts, lo, hi, unit, window, gram)

    def ask(key, table):
        texts = Texts(table.column(text_col))
        found = [_keys(r.value, bits) for r in runs(texts)]
        keys, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0))
        bucket = (keys >> np.uint64(40)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(2**bits + 1))
        full = np.flatnonzero(np.diff(edges))
        blobs = [pack(_five(keys[edges[b] : edges[b + 1]]), np.packbits(times[edges[b] : edges[b + 1]] > 1)) for b in full]
        return _table(bucket=full, grp=[key[0].as_py()] * len(full), blob=blobs)

    def answer(key, table):
        grp = table.column("grp").to_numpy()
        keys, many, source = [], [], []
        for i, blob in enumerate(table.column("blob")):
            five, flags = unpack(blob.as_buffer())
            keys.append(_from_five(five))
            many.append(np.unpackbits(flags, count=len(keys[-1])).astype(bool))
            source.append(np.full(len(keys[-1]), i, dtype=np.int32))
        keys, many, source = np.concatenate(keys), np.concatenate(many), np.concatenate(source)
        order = np.argsort(keys, kind="stable")
        keys, many, source = keys[order], many[order], source[order]
        same = keys[1:] == keys[:-1]
        many[1:] |= same
        many[:-1] |= same
        keys, source = keys[many], source[many]
        full = np.unique(source)
        bucket = np.uint64(key[0].as_py()) << np.uint64(40)
        return _table(grp=grp[full], blob=[pack(keys[source == i] | bucket) for i in full])

    def send(key, table, answers):
        grp = key[0].as_py()
        if not len(table) or not len(answers):
            return _table(bucket=[], grp=[], kind=[], blob=[])
        repeated = np.sort(np.concatenate([unpack(b.as_buffer())[0] for b in answers.column("blob")]))
        table, ids, texts = _ordered(table, id_col, text_col)
        known: dict[bytes, int] = {}
        value, first, string, row, start, settled = [], [], [], [], [], []
        for r in runs(texts):
            keys = _keys(r.value, bits)
            at = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
            raw = r.data.tobytes()
            for i in np.flatnonzero(repeated[at] == keys).tolist():
                s = raw[r.from_byte[i] : r.to_byte[i]]
                if unit == "words":
                    s = b" ".join(s.split())
                n = known.setdefault(s, len(known))
                place = (ids[r.row[i]], r.start[i] if same_text else 0)
                if n == len(value):
                    value.append(r.value[i])
                    first.append(place)
                elif place > first[n]:
                    settled.append((r.row[i], r.start[i], r.count[i]))
                    continue
                string.append(n)
                row.append(r.row[i])
                start.append(r.start[i])
        value, string = np.array(value, dtype=np.uint64), np.array(string, dtype=np.int64)
        row, start = np.array(row, dtype=np.int32), np.array(start, dtype=np.int64)
        strings = list(known)
        bucket = (_keys(value, bits) >> np.uint64(40)).astype(np.int64)
        by_bucket = np.argsort(bucket[string], kind="stable")
        edges = np.searchsorted(bucket[string][by_bucket], np.arange(2**bits + 1))
        full, blobs = np.flatnonzero(np.diff(edges)), []
        for b in full:
            mine = by_bucket[edges[b] : edges[b + 1]]
            own, local = np.unique(string[mine], return_inverse=True)
            text = [strings[n] for n in own]
            sizes = np.array([len(t) for t in text], dtype=np.int32)
            blobs.append(
                pack(value[own], sizes, np.frombuffer(b"".join(text), np.uint8), local.astype(np.int32), row[mine], start[mine], ids[row[mine]], level=3)
            )
        kinds = [0] * len(full)
        full = list(full)
        if settled:
            done = np.array(settled, dtype=np.int64)
            full.append(grp % 2**bits)
            kinds.append(1)
            blobs.append(pack(done[:, 0], done[:, 1], done[:, 2], level=3))
        return _table(bucket=full, grp=[grp] * len(full), kind=kinds, blob=blobs)

    def decide(table):
        out_grp, out_blob, strings, known = [], [], [], {}
        value, string, group, row, start, ids = [], [], [], [], [], []
        for grp, kind, blob in zip(table.column("grp").to_pylist(), table.column("kind").to_pylist(), table.column("blob")):
            parts = unpack(blob.as_py(), compressed=True)
            if kind:
                out_grp.append(grp)
                out_blob.append(pack(*parts))
                continue
            values, sizes, text, local, rows, starts, row_ids = parts
            text, edges = text.tobytes(), np.append(0, np.cumsum(sizes)).tolist()
            number = np.empty(len(sizes), dtype=np.int64)
            for i in range(len(sizes)):
                s = text[edges[i] : edges[i + 1]]
                n = number[i] = known.setdefault(s, len(known))
                if n == len(strings):
                    strings.append(s)
                    value.append(values[i])
            string.append(number[local])
            group.append(np.full(len(local), grp, dtype=np.int64))
            row.append(rows.astype(np.int64))
            start.append(starts)
            ids.append(row_ids)
        if not strings:
            return _table(grp=out_grp, blob=out_blob)
        string, group, row, start, ids = (np.concatenate(x) for x in (string, group, row, start, ids))
        size = np.array([(s.count(b" ") + 1 if unit == "words" else len(s)) - window + 1 for s in strings], dtype=np.int64)
        order = np.lexsort((start, ids, string))
        string, group, row, start, ids = string[order], group[order], row[order], start[order], ids[order]
        leads = np.append(True, string[1:] != string[:-1])
        lead = np.flatnonzero(leads)  # the first occurrence of each string
        late = ids > ids[lead][string]
        if same_text:
            late |= (ids == ids[lead][string]) & (start > start[lead][string])
        removed = [(group[late], row[late], start[late], size[string[late]])]
        value = np.array(value, dtype=np.uint64)
        _, kind, members = np.unique(value, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(members[kind] > 1)  # a string alone with its minimiser shares no window with another
        if len(shared):
            which, at = settle([strings[i] for i in shared], value[shared], ids[lead][shared], start[lead][shared])
            which = shared[which]
            stay = np.flatnonzero(~late)  # every occurrence that ties with the first
            lo, hi = np.searchsorted(string[stay], which), np.searchsorted(string[stay], which, side="right")
            times = hi - lo
            o = stay[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())]
            at = np.repeat(at, times)
            removed.append((group[o], row[o], start[o] + at, np.ones(len(o), dtype=np.int64)))
        grp, row, start, count = (np.concatenate(x) for x in zip(*removed))
        order = np.argsort(grp, kind="stable")
        grp, row, start, count = grp[order], row[order], start[order], count[order]
        own, edges = np.unique(grp, return_index=True)
        edges = np.append(edges, len(grp))
        for i, g in enumerate(own):
            s = slice(edges[i], edges[i + 1])
            out_grp.append(g)
            out_blob.append(pack(row[s], start[s], count[s]))
        return _table(grp=out_grp, blob=out_blob)

    def close(key, table, verdicts):
        table, _, texts = _ordered(table, id_col, text_col)
        parts = [unpack(b.as_buffer()) for b in verdicts.column("blob")]
        row, start, count = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for i in range(3))
        return finish(table.drop_columns(["_grp"]), texts, {"row": row, "start": start, "count": count})

    asked = by_group.applyInArrow(ask, "bucket int, grp int, blob binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "grp int, blob binary")
    sent = by_group.cogroup(answers.groupBy("grp")).applyInArrow(send, "bucket int, grp int, kind int, blob binary")
    verdicts = sent.groupBy("bucket").applyInArrow(decide, "grp int, blob binary")
    return by_group.cogroup(verdicts.groupBy("grp")).applyInArrow(close, schema)


def covered(n: int, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Mask of ``n`` units under the ranges ``[at, until)``."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, until, -1)
    return np.cumsum(change[:-1]) > 0
