"""Near-duplicate texts: Jaccard join as a blocked sparse product of texts by n-gram incidence.

Two sets of n-grams x, y with 100 * |x & y| >= 75 * |x | y| share at least 3/7 (|x| + |y|) n-grams,
and if both are sorted by one global order, at least one among the first |x| - ceil(0.75 |x|) + 1
of each. The columns that bring texts together are therefore those first n-grams only, rarest
first. They are dealt to blocks by hash; columns of one text are dropped, and texts with equal
sets are one row.

To find components not every pair is needed. Each text is first tried with one text, of smallest
hash among those it shares columns with. Columns whose texts are then all in one component are
closed. In open columns of few texts overlaps are accumulated per pair over the columns, pairs
below the bound that their sizes give are discarded, and the rest are counted exactly. The texts
of dense open columns are put into blocks of bounded size, texts that share columns together, and
each pair of blocks that shares such a column is multiplied over slices of n-grams; what leaves
that task is one link per pair of components. A link between two different texts is thus found or
already implied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.components import components
from pathlore.llm.spans import Texts, mix, ngram_hash, pack, unpack, words
from pathlore.session import cut_lineage

WORDS = 5
SLICE_BYTES = 1_000_000
BLOCK_BYTES = 32_000_000  # text bytes per block of columns
COUNTER_BYTES, COUNTER_BITS = 4096, 22  # a frequency counter for so many text bytes, 2 ** 22 at most; they only set the column order
SALTS = 16
ROWS, GRAMS = 1000, 300_000  # texts and n-grams of a block of the product, but for a longer text
DENSE = 256  # texts from which a column's pairs are multiplied in blocks and not listed
COLUMNS = 4096  # n-grams multiplied at once


def _sets(texts: Texts, lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of texts ``lo:hi``: text, hash, index of the first word; and the word hashes."""
    base = texts.offsets[lo]
    data, offsets = texts.data[base : texts.offsets[hi]], texts.offsets[lo : hi + 1] - base
    _, _, first, h = words(data, offsets, lower=True)
    count = np.diff(first)
    grams = ngram_hash(h, n)
    text = np.repeat(np.arange(hi - lo), count)
    at = np.flatnonzero(np.arange(len(grams)) + n <= np.repeat(first[1:], count)[: len(grams)])
    text, gram = text[at], grams[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is the only n-gram; its hash knows its length
        whole = np.array([mix(ngram_hash(h[first[i] : first[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short], dtype=np.uint64)
        text, gram, at = np.append(text, short), np.append(gram, whole), np.append(at, first[short])
    order = np.lexsort((at, gram, text))
    text, gram, at = text[order], gram[order], at[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new], at[new], h


def _need(size):
    """Smallest size a partner may have, and the overlap it then has: ceil(0.75 * size)."""
    return (3 * size + 3) // 4


def _batches(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[Texts, int, int]]:
    texts = Texts(batch.column(text_col))
    for lo, hi in texts.slices(SLICE_BYTES):
        yield texts, lo, hi


def _profile(docs: DataFrame, n: int, counters: int) -> DataFrame:
    """Per text: id, number of n-grams, set fingerprint; per partition: word and n-gram counters."""

    def run(batches):
        word_count, gram_count = np.zeros(counters, np.int64), np.zeros(counters, np.int64)
        for batch in batches:
            for texts, lo, hi in _batches(batch, "text"):
                text, gram, _, h = _sets(texts, lo, hi, n)
                word_count += np.bincount((h & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
                gram_count += np.bincount((gram & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
                edges = np.searchsorted(text, np.arange(hi - lo + 1))
                total = [np.append(np.uint64(0), np.cumsum(x)) for x in (gram, mix(gram ^ np.uint64(0x5BD1E9955BD1E995)))]
                one, two = (np.diff(t[edges]).view(np.int64) for t in total)
                ids = batch.column("id").slice(lo, hi - lo)
                size = np.diff(edges)
                yield pa.RecordBatch.from_pydict(
                    {"id": ids, "n": pa.array(size), "one": pa.array(one), "two": pa.array(two), "part": pa.nulls(hi - lo, pa.int32()), "blob": pa.nulls(hi - lo, pa.binary())}
                )
        parts = 16
        blobs = [pack(w, g, level=3) for w, g in zip(np.split(word_count, parts), np.split(gram_count, parts))]
        none = pa.nulls(parts, pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"id": none, "n": none, "one": none, "two": none, "part": pa.array(range(parts), pa.int32()), "blob": pa.array(blobs, pa.binary())}
        )

    return cut_lineage(docs.mapInArrow(run, "id long, n long, one long, two long, part int, blob binary"))


def _folded(rows: DataFrame, add) -> list[np.ndarray]:
    """Blobs (part, blob) combined per part by ``add``, in two steps; parts one after another on the driver."""

    def fold(table):
        arrays = [unpack(b.as_py(), compressed=True) for b in table.column("blob")]
        both = [add([a[i] for a in arrays]) for i in range(len(arrays[0]))]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "blob": pa.array([pack(*both, level=3)], pa.binary())})

    halves = rows.withColumn("half", F.pmod(F.xxhash64("blob"), F.lit(64)))
    once = halves.groupBy("part", "half").applyInArrow(lambda t: fold(t), "part int, blob binary")
    found = once.groupBy("part").applyInArrow(lambda t: fold(t), "part int, blob binary").collect()
    arrays = [unpack(bytes(r["blob"]), compressed=True) for r in sorted(found, key=lambda r: r["part"])]
    return [np.concatenate(x) for x in zip(*arrays)]


def _frequencies(profile: DataFrame, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of words and n-grams over all texts; 16 bytes a counter reach the driver."""
    both = _folded(profile.where("part is not null").select("part", "blob"), lambda x: np.sum(x, axis=0))
    return tuple(both) if both else (np.zeros(counters), np.zeros(counters))


def _bitmap(ids: DataFrame, count: int) -> np.ndarray:
    """A bit per hashed id, about 16 bits an id and 8 MB at most: what is not in it is not in ``ids``."""
    bits = 1 << min(26, max(16, (16 * count).bit_length()))

    def run(batches):
        mine = np.zeros(bits, dtype=bool)
        for batch in batches:
            mine[(mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
        blobs = [pack(p, level=1) for p in np.split(np.packbits(mine), 16)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    found = _folded(ids.mapInArrow(run, "part int, blob binary"), lambda x: np.bitwise_or.reduce(x, axis=0))
    return found[0] if found else np.zeros(bits // 8, np.uint8)


def _columns(docs: DataFrame, n: int, bits: int, word_count: np.ndarray, gram_count: np.ndarray) -> DataFrame:
    """Incidence rows (key, doc, n, centre) of the columns that at least two different sets share.

    ``centre`` is the text of smallest hash among those of similar size in the column.
    """
    # expected frequency of an n-gram from its words, and what its counter has beyond the usual:
    # integers, four to an octave, so that every task orders columns alike
    total = max(1, int(word_count.sum()))
    share = np.round(4 * np.log2(np.maximum(word_count, 1) / total)).astype(np.int16)
    everything = round(4 * np.log2(total))
    usual = np.median(gram_count) + 4 * np.sqrt(np.median(gram_count) + 1)
    excess = np.round(4 * np.log2(1 + np.maximum(gram_count - usual, 0))).astype(np.uint8)
    last = np.uint64(len(share) - 1)

    def prefix(texts: Texts, lo: int, hi: int):
        """Text and hash of each text's first columns; set sizes and fingerprints."""
        text, gram, at, h = _sets(texts, lo, hi, n)
        part = np.append(share[(h & last).astype(np.int64)].astype(np.int64), np.zeros(n, np.int64))
        expected = sum(part[at + i] for i in range(n)) + everything
        level = np.maximum(expected, excess[(gram & last).astype(np.int64)])
        level = np.clip(level, 0, 126).astype(np.uint64)
        place = (level << np.uint64(56)) | (gram >> np.uint64(8))
        order = np.lexsort((place, text))
        text, gram, place = text[order], gram[order], place[order]
        edges = np.searchsorted(text, np.arange(hi - lo + 1))
        size = np.diff(edges)
        keep = size - _need(size) + (size > 0)
        index = np.repeat(edges[:-1] - np.cumsum(keep) + keep, keep) + np.arange(keep.sum())
        totals = np.append(np.uint64(0), np.cumsum(mix(gram ^ np.uint64(0x5BD1E9955BD1E995))))
        return text[index], gram[index], size, np.diff(totals[edges])

    def deal(batches):
        for batch in batches:
            ids_all = batch.column("id").to_numpy(zero_copy_only=False)
            for texts, lo, hi in _batches(batch, "text"):
                text, gram, size, mark = prefix(texts, lo, hi)
                ids = ids_all[lo:hi]
                # of texts with one set only the smallest id is sent
                order = np.lexsort((ids, mark, size))
                first = np.ones(len(order), dtype=bool)
                first[1:] = (mark[order][1:] != mark[order][:-1]) | (size[order][1:] != size[order][:-1])
                sent = np.zeros(hi - lo, dtype=bool)
                sent[order[first]] = True
                key = mix(gram[sent[text]]) >> np.uint64(24 - bits)  # mixed as low hashes come first
                text = text[sent[text]]
                block = (key >> np.uint64(40)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                key, text, block = key[order], text[order], block[order]
                edges = np.searchsorted(block, np.arange(2**bits + 1))
                full = np.flatnonzero(np.diff(edges))
                blobs = []
                for b in full:
                    s = slice(edges[b], edges[b + 1])
                    own, local = np.unique(text[s], return_inverse=True)
                    five = np.ascontiguousarray(key[s]).view(np.uint8).reshape(-1, 8)[:, :5].copy().reshape(-1)
                    local = local.astype(np.uint16 if len(own) < 65536 else np.uint32)
                    blobs.append(pack(five, local, ids[own], size[own].astype(np.int32), mark[own]))
                yield pa.RecordBatch.from_pydict({"block": pa.array(full, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def meet(key, table):
        five, local, ids, size, mark, base = [], [], [], [], [], 0
        for blob in table.column("blob"):
            a, b, c, d, e = unpack(blob.as_buffer())
            five.append(a)
            local.append(b.astype(np.int64) + base)
            for to, x in ((ids, c), (size, d), (mark, e)):
                to.append(x)
            base += len(c)
        five, local, ids, size, mark = (np.concatenate(x) for x in (five, local, ids, size, mark))
        wide = np.zeros((len(five) // 5, 8), dtype=np.uint8)
        wide[:, :5] = five.reshape(-1, 5)
        column = wide.view(np.uint64).reshape(-1)
        # texts of one set are one row, named by the smallest id
        order = np.lexsort((ids, mark, size))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (mark[order][1:] == mark[order][:-1]) & (size[order][1:] == size[order][:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        row = np.empty(len(order), dtype=np.int64)
        row[order] = head
        local = row[local]
        order = np.lexsort((local, column))
        column, local = column[order], local[order]
        new = np.ones(len(column), dtype=bool)
        new[1:] = (column[1:] != column[:-1]) | (local[1:] != local[:-1])
        column, local = column[new], local[new]
        shared = np.zeros(len(column), dtype=bool)
        twin = column[1:] == column[:-1]
        shared[1:] |= twin
        shared[:-1] |= twin
        column, local = column[shared] | (np.uint64(key[0].as_py()) << np.uint64(40)), local[shared]
        # the centre of each column and size band
        band = np.floor(np.log(size[local]) / np.log(4 / 3)).astype(np.int64)
        order = np.lexsort((mix(ids[local].view(np.uint64)), band, column))
        column, local, band = column[order], local[order], band[order]
        head = np.ones(len(column), dtype=bool)
        head[1:] = (column[1:] != column[:-1]) | (band[1:] != band[:-1])
        centre = ids[local[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]] if len(head) else ids[:0]
        return pa.table({"key": pa.array(column.view(np.int64)), "doc": pa.array(ids[local]), "n": pa.array(size[local].astype(np.int64)), "centre": pa.array(centre)})

    dealt = docs.mapInArrow(deal, "block int, blob binary")
    return dealt.groupBy("block").applyInArrow(meet, "key long, doc long, n long, centre long")


def _with_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, ...) with ``grams``, each text's sorted n-gram hashes of 6 bytes.

    Texts whose id is not in a bitmap of the wanted ids don't reach the shuffle of the join.
    """
    ids = wanted.select("id").distinct()
    bitmap = _bitmap(ids, ids.count())

    def keep(batches):
        last = np.uint64(len(bitmap) * 8 - 1)
        for batch in batches:
            at = (mix(batch.column("id").to_numpy().view(np.uint64)) & last).astype(np.int64)
            yield batch.filter(pa.array((bitmap[at >> 3] >> (7 - (at & 7))) & 1 == 1))

    extra = [c for c in wanted.columns if c != "id"]

    def run(batches):
        for batch in batches:
            for texts, lo, hi in _batches(batch, "text"):
                text, gram, _, _ = _sets(texts, lo, hi, n)
                order = np.lexsort((gram >> np.uint64(16), text))
                six = np.ascontiguousarray(gram[order] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].copy()
                edges = np.searchsorted(text, np.arange(hi - lo + 1))
                blobs = [six[edges[i] : edges[i + 1]].tobytes() for i in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict({"id": part.column("id")} | {c: part.column(c) for c in extra} | {"grams": pa.array(blobs, pa.binary())})

    near = docs.mapInArrow(keep, "id long, text string")
    schema = ["id long", *[f"{c} long" for c in extra], "grams binary"]
    return near.join(wanted.hint("merge"), "id").select("id", *extra, "text").mapInArrow(run, ", ".join(schema))


def _six(value) -> np.ndarray:
    """Hashes of 6 bytes."""
    raw = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).reshape(-1)


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (a, b, x, y) whose exact overlap reaches the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = _six(x), _six(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _product(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of two blocks (sides 0 and 1; 0 alone: with itself), one per pair of labels."""
    side, doc, label = (table.column(c).to_numpy() for c in ("side", "doc", "label"))
    grams = [_six(v) for v in table.column("grams")]
    two = bool(side.any())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == int(two))
    size = np.array([len(g) for g in grams], dtype=np.int64)
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), size)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    code = np.cumsum(np.append(0, code[1:] != code[:-1])) if len(code) else code
    place = np.empty(len(grams), dtype=np.int64)
    place[right] = np.arange(len(right))
    place[left] = np.arange(len(left)) if two else place[left]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        s = slice(*np.searchsorted(code, [lo, lo + COLUMNS]))
        mine, column = owner[s], code[s] - lo
        parts = []
        for rows, k in ((left, 0), (right, int(two))):
            own = side[mine] == k
            x = np.zeros((len(rows), COLUMNS), dtype=np.float32)
            x[place[mine[own]], column[own]] = 1
            parts.append(x)
        both += parts[0] @ parts[1].T
    both = both.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((100 * both >= percent * union) & (both > 0) & (label[left][:, None] != label[right][None, :]))
    i, j = left[i], right[j]
    pair = np.sort(np.column_stack([label[i], label[j]]), axis=1)
    _, first = np.unique(pair, axis=0, return_index=True)
    return doc[i[first]], doc[j[first]]


def _pairs(side: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in different components that share enough columns.

    Overlaps are accumulated over the columns and pairs below the bound by their sizes are
    discarded: common n-grams up to the earlier of two texts' last columns are columns of both,
    and behind it that text has ceil(0.75 n) - 1 n-grams left; together they must reach 3/7 of
    both sizes. The bound leaves one for two columns of a text that share a key. Pairs that also
    share a dense column are found there.
    """
    a, b = (side.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "label")]) for s in "ab")
    across = a.join(b, "key").where("label_a <> label_b and doc_a < doc_b and 4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    counted = across.groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    need = F.floor((3 * F.greatest("n_a", "n_b") + 3) / 4)
    enough = counted.where(7 * (F.col("common") + need) >= 3 * (F.col("n_a") + F.col("n_b")))
    return enough.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()


def _blocks(side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, label, block) of texts in dense columns, and pairs of blocks that share one.

    A text's family is the smallest component that it shares a column with; families are cut
    into blocks of bounded size.
    """
    family = side.groupBy("doc", "label", "n").agg(F.min("least").alias("family"))
    sizes = family.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / ROWS, F.sum("n") / GRAMS)).alias("parts"))
    placed = family.join(sizes.hint("merge"), "family")
    placed = cut_lineage(placed.select("doc", "label", F.xxhash64("family", F.pmod(F.xxhash64("doc"), "parts")).alias("block")))
    held = side.select("key", "doc").join(placed.hint("merge"), "doc")
    held = cut_lineage(held.groupBy("key", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")))
    two = held.select("key", *[F.col(c).alias(f"{c}_2") for c in ("block", "least", "most")])
    met = held.join(two.hint("merge"), "key").where("block < block_2 and (least <> most_2 or most <> least_2)")
    met = met.select("block", "block_2").union(held.where("least < most").select("block", F.col("block").alias("block_2")))
    return placed, cut_lineage(met.distinct())


def _multiplied(placed: DataFrame, met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components from the products of all pairs of blocks."""
    rows = placed.join(sets.hint("merge"), "doc")
    sides = []
    for number, at, used in ((0, "block", "true"), (1, "block_2", "block < block_2")):
        pairs = met.where(used).select(F.col("block").alias("one"), F.col("block_2").alias("two"), F.col(at).alias("at"))
        both = rows.join(pairs.hint("merge"), rows["block"] == pairs["at"])
        sides.append(both.select("one", "two", F.lit(number).cast("long").alias("side"), "doc", "label", "grams"))

    def multiply(table):
        a, b = _product(table, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sides[0].union(sides[1]).groupBy("one", "two").applyInArrow(lambda t: multiply(t), "a long, b long")


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_gram: int = WORDS
) -> DataFrame:
    """One row (id, n_shingles, component_id) per row of ``documents``, similarity 0.75.

    A text's set is its distinct n-grams of words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a
    text with fewer words has one, its whole sequence. Null texts and texts without words have
    none, link with nothing and are their own component. Two texts link if 100 times the
    intersection reaches 75 times the union; ``component_id`` is the smallest id reachable.

    Ids should be unique: rows that share one are separate texts and get the component of their
    text, except that two texts are joined if the id is the smallest of both their sets of equal
    texts. A row with a null id takes no part and has a null component. N-grams are compared by 64-bit hashes. Columns not named are
    not read.
    """
    percent = 75
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(total // BLOCK_BYTES).bit_length())
    counters = 1 << min(COUNTER_BITS, max(12, int(total // COUNTER_BYTES).bit_length()))
    profile = _profile(docs, words_per_gram, counters)
    word_count, gram_count = _frequencies(profile, counters)
    named = docs.where("id is not null")
    rows = cut_lineage(_columns(named, words_per_gram, bits, word_count, gram_count))

    # a text is tried with the centre that it shares most of a quarter of its columns with
    tried = rows.where("doc <> centre and pmod(key, 4) = 0").groupBy("doc", "centre").agg(F.count(F.lit(1)).alias("common"))
    best = tried.groupBy("doc").agg(F.max_by("centre", F.struct("common", "centre")).alias("centre"))
    best = cut_lineage(best.select(F.col("doc").alias("id"), F.col("centre").alias("b")))
    one = _with_sets(named, words_per_gram, best).select(F.col("id").alias("a"), "b", F.col("grams").alias("x"))
    two = _with_sets(named, words_per_gram, best.select(F.col("b").alias("id")).distinct()).select(F.col("id").alias("b"), F.col("grams").alias("y"))
    links = cut_lineage(_linked(one.join(two.hint("merge"), "b"), percent))
    labels = components(links)

    # then the columns that still hold several components
    labelled = rows.select("key", "doc", "n").join(labels.withColumnRenamed("node", "doc").hint("merge"), "doc", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "doc")).repartition("key")
    held = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("texts"))
    side = cut_lineage(labelled.join(held.where("least < most").drop("most").hint("merge"), "key"))
    pairs = cut_lineage(_pairs(side.where(F.col("texts") <= DENSE)))
    placed, met = _blocks(side.where(F.col("texts") > DENSE))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(placed.select("doc")).distinct()
    sets = cut_lineage(_with_sets(named, words_per_gram, wanted).withColumnRenamed("id", "doc"))
    one, two = (sets.select(F.col("doc").alias(k), F.col("grams").alias(x)).hint("merge") for k, x in (("a", "x"), ("b", "y")))
    links = cut_lineage(links.union(_linked(pairs.join(one, "a").join(two, "b"), percent)).union(_multiplied(placed, met, sets, percent)))
    labels = components(links)

    texts = profile.where("part is null")
    known = texts.where("id is not null and n > 0")
    classes = known.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.max("id").alias("most"))
    found = (
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .where("label is not null or most > rep")
        .select("n", "one", "two", F.coalesce("label", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = salted.join(found, ["n", "one", "two", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
