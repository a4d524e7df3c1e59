"""Language-model scores: every segmentation of a word into vocabulary pieces, summed by a lattice.

A word is spelled by a first piece (one that begins with the space mark), further pieces and a
stop. The marginal probability over all segmentations is the log-space forward recursion over the
word's bytes. The vocabulary's scores are ranks; they give the weights to start from, and
expectation maximisation over the training words, each as often as it occurs, refines them. A
text's probability is the product over its words, known or new, and an end.

Counting, learning and scoring run over all texts: words travel as 64-bit hashes in blobs, once
per partition or group of texts, to hash buckets; texts are hashed to groups that ask the buckets
for their words and get counts and scores back. Only piece weights (one number per piece of the
vocabulary) and two totals reach the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.piece_codec import MARK, _fields
from pathlore.llm.spans import BASE, BYTE_HASH, Texts, pack, unpack, words
from pathlore.session import cut_lineage

SLICE_BYTES = 1_000_000
GROUP_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000  # text bytes per bucket of words
CELLS = 100_000  # bytes of words laid out at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END_SHARE = 0.01, 100  # share of the ends among tokens before any is seen, and its weight in tokens


class Pieces:
    """Vocabulary pieces by hash and length; a byte piece only where no piece is that byte."""

    def __init__(self, model: bytes):
        import struct

        text, rank, kind = [], [], []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                text.append(f[1].decode())
                rank.append(-struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kind.append(f.get(3, 1))
        mark = MARK.encode()
        first, rest = {}, {}
        for t, r, k in zip(text, rank, kind):
            if k == 1:  # ordinary
                (first if t.startswith(MARK) else rest)[t.encode().removeprefix(mark)] = max(r, 0.0)
        first = {t: r for t, r in first.items() if mark not in t}
        rest = {t: r for t, r in rest.items() if mark not in t}
        first.setdefault(b"", float(len(text)))
        for b in range(256):
            rest.setdefault(bytes([b]), float(len(text)))
        self.size = len(first) + len(rest) + 1
        self.stop = self.size - 1
        self.heads = len(first)
        self.bare = list(first).index(b"")
        weight = np.array([1 / (100 + r) for r in [*first.values(), *rest.values()]] + [0.0])
        weight[: self.heads] /= weight[: self.heads].sum()
        weight[self.heads :] *= 0.7 / weight[self.heads :].sum()
        weight[self.stop] = 0.3
        self.prior = weight
        self.longest = max(map(len, [*first, *rest]))
        self.tables = {}
        for name, table, at in (("first", first, 0), ("rest", rest, self.heads)):
            for size in range(1, self.longest + 1):
                mine = [(t, at + i) for i, t in enumerate(table) if len(t) == size]
                if not mine:
                    continue
                h = BYTE_HASH[np.frombuffer(b"".join(t for t, _ in mine), np.uint8)].reshape(-1, size)
                key = h[:, 0].copy()
                for i in range(1, size):
                    key = key * BASE + h[:, i]
                order = np.argsort(key)
                near = np.zeros(1 << 18, dtype=bool)
                near[(key >> np.uint64(46)).astype(np.int64)] = True
                self.tables[name, size] = key[order], np.array([n for _, n in mine], dtype=np.int32)[order], near

    def find(self, name: str, size: int, key: np.ndarray) -> np.ndarray:
        """Piece numbers of hashed strings, -1 where there is none."""
        out = np.full(len(key), -1, dtype=np.int32)
        if (name, size) in self.tables:
            keys, number, near = self.tables[name, size]
            at = np.flatnonzero(near[(key >> np.uint64(46)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            hit = keys[place] == key[at]
            out[at[hit]] = number[place[hit]]
        return out

    def re_estimated(self, expected: np.ndarray, strength: float = 1000.0) -> np.ndarray:
        """Weights from expected counts and ``strength`` counts spread by the vocabulary's scores."""
        out = expected + strength * self.prior
        out[: self.heads] /= out[: self.heads].sum()
        out[self.heads :] /= out[self.heads :].sum()
        return out


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    """The vocabulary, read once per worker."""
    return Pieces(model)


def _same_length(pieces: Pieces, weight: np.ndarray, letters: np.ndarray, expected: np.ndarray | None, times: np.ndarray | None) -> np.ndarray:
    """Natural logs of the lattice sums of equally long words (rows of ``letters``); adds expected counts of ``times`` each."""
    count, length = letters.shape
    logs = np.append(np.log(weight), -np.inf)  # piece -1 has no weight
    h = BYTE_HASH[letters]
    arcs, heads, key = {}, {}, h
    for size in range(1, min(pieces.longest, length) + 1):
        if size > 1:
            key = key[:, :-1] * BASE + h[:, size - 1 :]
        arcs[size] = pieces.find("rest", size, np.ascontiguousarray(key).reshape(-1)).reshape(count, -1)
        heads[size] = pieces.find("first", size, np.ascontiguousarray(key[:, 0]))
    cost = {size: logs[a] for size, a in arcs.items()}
    alpha = np.full((length + 1, count), -np.inf)
    alpha[0] = logs[pieces.bare]
    for end in range(1, length + 1):
        sizes = [s for s in arcs if s <= end]
        terms = np.stack([alpha[end - s] + cost[s][:, end - s] for s in sizes] + ([logs[heads[end]]] if end in heads else []))
        top = terms.max(axis=0)
        alpha[end] = top + np.log(np.exp(terms - top).sum(axis=0))
    total = alpha[length] + logs[pieces.stop]
    if expected is not None:
        beta = np.full((length + 1, count), -np.inf)
        beta[length] = logs[pieces.stop]
        for at in range(length - 1, -1, -1):
            terms = np.stack([cost[s][:, at] + beta[at + s] for s in arcs if at + s <= length])
            top = terms.max(axis=0)
            beta[at] = top + np.log(np.exp(terms - top).sum(axis=0))
        for size, found in arcs.items():
            row, at = np.nonzero(found >= 0)
            share = np.exp(alpha[at, row] + cost[size][row, at] + beta[at + size, row] - total[row])
            expected += np.bincount(found[row, at], weights=share * times[row], minlength=pieces.size)
            row = np.flatnonzero(heads[size] >= 0)
            share = np.exp(logs[heads[size][row]] + beta[size, row] - total[row])
            expected += np.bincount(heads[size][row], weights=share * times[row], minlength=pieces.size)
        expected[pieces.bare] += (np.exp(logs[pieces.bare] + beta[0] - total) * times).sum()
        expected[pieces.stop] += times.sum()
    return total


def lattice(pieces: Pieces, weight: np.ndarray, data: np.ndarray, size: np.ndarray, expected: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each word; ``data`` holds their bytes one after another.

    ``expected`` gains the expected count of every piece, each word taken ``times`` (or once).
    """
    out = np.empty(len(size))
    times = np.ones(len(size)) if times is None else times
    begin = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        length = int(size[order[lo]])
        hi = min(int(np.searchsorted(size[order], length, side="right")), lo + max(1, CELLS // length))
        mine = order[lo:hi]
        letters = data[begin[mine][:, None] + np.arange(length)[None, :]]
        out[mine] = _same_length(pieces, weight, letters, expected, times[mine])
        lo = hi
    return out


def _unique_words(texts: Texts, rows: np.ndarray):
    """Per slice: hashes, counts in ``rows``, sizes and lower-case bytes of the distinct words."""
    for lo, hi in texts.slices(SLICE_BYTES):
        base = texts.offsets[lo]
        data = LOWER[texts.data[base : texts.offsets[hi]]]
        start, end, first, h = words(data, texts.offsets[lo : hi + 1] - base)
        keys, at, where = np.unique(h, return_index=True, return_inverse=True)
        learn = np.repeat(rows[lo:hi], np.diff(first))
        times = np.bincount(where, weights=learn, minlength=len(keys)).astype(np.int64)
        size = end[at] - start[at]
        place = np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield keys, times, size, data[place]


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of several lists, counts added."""
    key, times, size, data = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keys, at, where = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, where, times)
    begin = np.cumsum(size) - size
    size = size[at]
    place = np.repeat(begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return keys, total, size, data[place]


def _by_bucket(keys: np.ndarray, bits: int):
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(bucket, np.arange(2**bits + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(edges[b], edges[b + 1])


def _count_words(docs: DataFrame, bits: int) -> DataFrame:
    """The training vocabulary: rows (bucket, docs, blob of hashes, counts, sizes, bytes)."""

    def count(batches):
        parts, held, seen = [], 0, 0

        def flush():
            keys, times, size, data = _merged(parts)
            ends = np.append(0, np.cumsum(size))
            found = list(_by_bucket(keys, bits))
            blobs = [pack(keys[s], times[s], size[s].astype(np.int32), data[ends[s.start] : ends[s.stop]], level=3) for _, s in found]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in found], pa.int32()), "docs": pa.array([0] * len(found), pa.int64()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            seen += len(batch)
            texts = Texts(batch.column("text"))
            for part in _unique_words(texts, np.ones(len(batch), dtype=np.int64)):
                parts.append(part)
                held += len(part[0])
                if held > 3_000_000:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([0], pa.int32()), "docs": pa.array([seen], pa.int64()), "blob": pa.nulls(1, pa.binary())})

    def merge(key, table):
        parts = [unpack(b.as_py(), compressed=True) for b in table.column("blob") if b.is_valid]
        docs_seen = sum(table.column("docs").to_pylist())
        none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
        keys, times, size, data = _merged(parts) if parts else none
        blob = pack(keys, times, size.astype(np.int32), data, level=3)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([docs_seen], pa.int64()), "words": pa.array([int(len(keys))], pa.int64()), "tokens": pa.array([int(times.sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "bucket int, docs long, blob binary")
    return cut_lineage(counted.groupBy("bucket").applyInArrow(merge, "bucket int, docs long, words long, tokens long, blob binary"))


def _learn(vocabulary: DataFrame, model: bytes, rounds: int) -> np.ndarray:
    """Piece weights after ``rounds`` of expectation maximisation over the counted words."""
    pieces = _pieces(model)
    weight = pieces.prior

    def expect(now):
        def run(batches):
            mine = _pieces(model)
            expected = np.zeros(mine.size)
            for batch in batches:
                for blob in batch.column("blob"):
                    _, times, size, data = unpack(blob.as_py(), compressed=True)
                    if len(size):
                        lattice(mine, now, data, size.astype(np.int64), expected, times)
            yield pa.RecordBatch.from_pydict({"half": pa.array([0], pa.int32()), "blob": pa.array([pack(expected, level=3)], pa.binary())})

        return run

    def add(table):
        total = np.sum([unpack(b.as_py(), compressed=True)[0] for b in table.column("blob")], axis=0)
        return pa.table({"half": pa.array([0], pa.int32()), "blob": pa.array([pack(total, level=3)], pa.binary())})

    for _ in range(rounds):
        sums = vocabulary.select("blob").mapInArrow(expect(weight), "half int, blob binary")
        sums = sums.withColumn("half", F.pmod(F.xxhash64("blob"), F.lit(64)).cast("int"))
        rows = sums.groupBy("half").applyInArrow(lambda t: add(t), "half int, blob binary").collect()
        expected = np.sum([unpack(bytes(r["blob"]), compressed=True)[0] for r in rows], axis=0) if rows else np.zeros(pieces.size)
        weight = pieces.re_estimated(expected)
    return weight


def score_texts(
    documents: DataFrame,
    held_out: Column,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 2,
) -> DataFrame:
    """One row (id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``documents``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and one end per text. Counts
    c are over the texts that are not held out: N tokens, V distinct. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))); ``score`` is the model's log10 probability of the text:
    the lattice's marginal of every word and the share of ends, learned from the same counts.
    ``model`` is a serialised SentencePiece model whose pieces and scores are used.

    Null and empty texts are an end alone. ``held_out`` null counts as false. A null id is kept;
    repeated rows are scored (and learned from) each. Without training texts the base is that
    of counts of zero and the model the untrained lattice. Columns not named are not read.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, bits = max(1, -(-total // GROUP_BYTES)), int(total // BUCKET_BYTES).bit_length()
    vocabulary = _count_words(docs.where(~F.col("held_out")), bits)
    weight = _learn(vocabulary, model, rounds)
    sums = vocabulary.agg(F.sum("docs"), F.sum("words"), F.sum("tokens")).first()
    ends, types, tokens = (x or 0 for x in sums)
    n, v = tokens + ends, types + (ends > 0)
    end_share = (ends + END_SHARE[0] * END_SHARE[1]) / (n + END_SHARE[1])
    base_log = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def marginal(data, size):
        return (np.log1p(-end_share) + lattice(_pieces(model), weight, data, size)) / np.log(10)

    end_score = float(np.log10(end_share))

    def distinct(texts: Texts):
        parts = [(k, t, s, d) for k, t, s, d in _unique_words(texts, np.zeros(len(texts), dtype=np.int64))]
        return _merged(parts) if parts else None

    def ask(key, table):
        found = distinct(Texts(table.column("text")))
        cuts = list(_by_bucket(found[0], bits)) if found else []
        return pa.table({"bucket": pa.array([b for b, _ in cuts], pa.int32()), "grp": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "blob": pa.array([pack(found[0][s]) for _, s in cuts], pa.binary())})

    def answer(key, known, asked):
        grp, blobs = [], []
        if len(asked):
            keys, times, size, data = unpack(known.column("blob")[0].as_py(), compressed=True) if len(known) else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8))
            score = marginal(data, size.astype(np.int64)) if len(keys) else np.empty(0)
            keys, times, score = np.append(keys, np.uint64(0)), np.append(times, 0), np.append(score, 0.0)
            for g, blob in zip(asked.column("grp").to_pylist(), asked.column("blob")):
                (mine,) = unpack(blob.as_buffer())
                at = np.minimum(np.searchsorted(keys[:-1], mine), len(keys) - 1)
                hit = keys[at] == mine
                grp.append(g)
                blobs.append(pack(np.where(hit, times[at], 0), np.where(hit, score[at], 0.0), level=3))
        return pa.table({"grp": pa.array(grp, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(grp), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def close(key, table, answers):
        texts = Texts(table.column("text"))
        found = distinct(texts)
        if found is None:
            keys, times, score = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
        else:
            keys, _, size, data = found
            order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
            parts = [unpack(answers.column("blob")[int(i)].as_py(), compressed=True) for i in order]
            times, score = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(2))
            score = score.copy()
            new = np.flatnonzero(times == 0)
            if len(new):
                begin = np.cumsum(size) - size
                place = np.repeat(begin[new] - np.cumsum(size[new]) + size[new], size[new]) + np.arange(size[new].sum())
                score[new] = marginal(data[place], size[new])
        base = base_log(times)
        rows = len(table)
        count, known, one, two = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
        for lo, hi in texts.slices(SLICE_BYTES):
            at = texts.offsets[lo]
            _, _, first, h = words(texts.data[at : texts.offsets[hi]], texts.offsets[lo : hi + 1] - at, lower=True)
            place, row = np.searchsorted(keys, h), np.repeat(np.arange(lo, hi), np.diff(first))
            count[lo:hi] = np.diff(first)
            known += np.bincount(row, weights=times[place] > 0, minlength=rows).astype(np.int64)
            one += np.bincount(row, weights=base[place], minlength=rows)
            two += np.bincount(row, weights=score[place], minlength=rows)
        return pa.table({
            "id": table.column("id"), "held_out": table.column("held_out"), "n_tokens": pa.array(count + 1),
            "n_known": pa.array(known + int(ends > 0)), "train_tokens": pa.array(np.full(rows, n, dtype=np.int64)),
            "base_score": pa.array(one + base_log(ends)), "score": pa.array(two + end_score),
        })

    grouped = docs.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("grp")
    asked = grouped.applyInArrow(ask, "bucket int, grp int, blob binary")
    answers = vocabulary.select("bucket", "blob").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "grp int, bucket int, blob binary")
    out = grouped.cogroup(answers.groupBy("grp")).applyInArrow(
        close, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("id", id_col)
