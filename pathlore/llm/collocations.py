"""Phrase collocations by best-first branch and bound over prefixes.

A phrase of count a, cut into parts of counts l and r, scores floor(1000000 * a * a / (l * r)), the
lowest cut counts. A phrase grown from a prefix p has a <= f(p) and a <= f(everything behind the
first word), so it scores at most 1000000 * f(p) / f(first word): a bound from prefix counts alone.
Words and pairs are counted in one pass. The frontier of a language are the pairs whose own score
or bound reaches a threshold; only they are grown, by one word to either side, which counts every
triple that could enter the result and every one that could swallow a pair of the frontier.
The threshold falls until enough phrases above it survive; then nothing outside the frontier
can change the result.

A word is a 64-bit hash of its language and bytes, a phrase the tuple of its words; the words
themselves are looked up again for the phrases that are returned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.llm.spans import Texts, mix, pack, unpack, words
from pathlore.session import cut_lineage

UNKNOWN = "und"
SLICE_BYTES = 2_000_000  # text that is counted at once
BUCKET_BYTES = 4_000_000  # text whose phrases are added up in one group
OFTEN, HELD = 32, 200_000  # count of a tuple in a chunk from which its task adds it up, and how many it holds
BIT_LIMIT = 26  # sets are known to the tasks as 2 ** 26 bits at most
SLICES = 64
ALL = np.uint64(2)  # marks the number of all words of a language
TURN = 21
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = bytes(range(97, 123))
_PLAIN[9] = 32
for _b in b".,;:!?\n\x0b\x0c\r":
    _PLAIN[_b] = 10
_PLAIN = bytes(_PLAIN)
_AHEAD = re.compile(rb"[ \n]*[^ \n]+[ \n]+[^ \n]+")
_GAP = re.compile(rb"[ \n]")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, text offsets, languages, own) of some texts, or of a part of a long one followed by two
    more words: phrases that start before byte ``own`` are counted there."""
    texts, langs = Texts(batch.column("text")), batch.column("lang").to_numpy()
    for lo, hi in texts.slices(SLICE_BYTES):
        raw = texts.data[texts.offsets[lo] : texts.offsets[hi]].tobytes().translate(_PLAIN)
        offsets = texts.offsets[lo : hi + 1] - texts.offsets[lo]
        if hi > lo + 1 or len(raw) <= 2 * SLICE_BYTES:
            yield np.frombuffer(raw, np.uint8), offsets, langs[lo:hi], len(raw)
            continue
        at = 0
        while at < len(raw):
            gap = _GAP.search(raw, at + SLICE_BYTES)
            stop = gap.start() if gap else len(raw)
            ahead = _AHEAD.match(raw, stop)
            end = ahead.end() if ahead else len(raw)
            if ahead:  # the second word to its end
                gap = _GAP.search(raw, end)
                end = gap.start() if gap else len(raw)
            yield np.frombuffer(raw[at:end], np.uint8), np.array([0, end - at]), langs[lo:hi], stop - at
            at = stop


def _keys(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, own: int):
    """Key and piece of every word, how many start a phrase here, word starts and ends."""
    begin, end, first, h = words(data, offsets)
    count = np.diff(first)
    key = mix(h ^ np.repeat(langs.view(np.uint64), count))
    piece = np.searchsorted(np.flatnonzero(data == 10), begin) + np.repeat(np.arange(len(langs)), count)
    return key, piece, int(np.searchsorted(begin, own)), begin, end


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ ((second << np.uint64(TURN)) | (second >> np.uint64(64 - TURN)))


def pair_key(first: str, second: str) -> Column:
    """The same in Spark."""
    return F.col(first).bitwiseXOR(F.shiftleft(second, TURN).bitwiseOR(F.shiftrightunsigned(second, 64 - TURN)))


def _summed(keys: list[np.ndarray], f: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of ``keys`` and the sums of ``f``."""
    joint = keys[0]
    for k in keys[1:]:
        joint = _pair_key(joint, k)
    order = np.argsort(joint)
    for _ in range(2):
        sorted_, joint_ = [k[order] for k in keys], joint[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_], axis=0)
        if not np.any(new[1:] & (joint_[1:] == joint_[:-1])):
            break
        order = np.lexsort(keys[::-1])  # different tuples of one joint key
    at = np.flatnonzero(new)
    return [k[at] for k in sorted_], np.add.reduceat(f[order], at) if len(at) else f[:0]


def _counted(docs: DataFrame, tuples: Callable[..., tuple[list[np.ndarray], np.ndarray]], width: int, least: int, total: int) -> DataFrame:
    """(w1, .., f): counts of the tuples of ``width`` keys that ``tuples`` finds in the chunks, if ``least`` or more; those that end in ``ALL`` always.

    Counts are added per chunk, dealt to buckets of bounded text by a hash of the tuple, and
    added there. Tuples that are frequent in a chunk are held back and sent once per task.
    """
    buckets = int(total // BUCKET_BYTES) + 1

    def dealt(keys: list[np.ndarray], f: np.ndarray) -> pa.RecordBatch:
        joint = keys[0]
        for k in keys[1:]:
            joint = _pair_key(joint, k)
        bucket = (mix(joint) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, f = bucket[order], [k[order] for k in keys], f[order]
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)], len(bucket))
        blobs = [pack(*[k[lo:hi] for k in keys], f[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edges[:-1]], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def run(batches):
        held = None
        for batch in batches:
            for chunk in _chunks(batch):
                keys, f = _summed(*tuples(*chunk))
                often = f >= OFTEN
                yield dealt([k[~often] for k in keys], f[~often])
                new = ([k[often] for k in keys], f[often])
                held = new if held is None else ([np.append(a, b) for a, b in zip(held[0], new[0])], np.append(held[1], new[1]))
                if len(held[1]) > HELD:
                    held = _summed(*held)
                    if len(held[1]) > HELD // 2:
                        yield dealt(*held)
                        held = None
        if held is not None:
            yield dealt(*_summed(*held))

    names = [f"w{i + 1}" for i in range(width)]

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_buffer()) for b in table.column("blob")]
        keys, f = _summed([np.concatenate([p[i] for p in parts]) for i in range(width)], np.concatenate([p[width] for p in parts]))
        enough = (f >= least) | (keys[-1] == ALL)
        return pa.table({n: pa.array(k[enough].view(np.int64)) for n, k in zip(names, keys)} | {"f": pa.array(f[enough])})

    schema = ", ".join(f"{n} long" for n in [*names, "f"])
    return docs.mapInArrow(run, "bucket long, blob binary").groupBy("bucket").applyInArrow(lambda t: add(t), schema)


def _words_and_pairs(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(word, language) with a 0 behind it, pairs (word, word) with a 1, languages with ``ALL`` and their words."""
    key, piece, here, begin, _ = _keys(data, offsets, langs, own)
    lang = langs[np.searchsorted(offsets, begin[:here], side="right") - 1].view(np.uint64)
    inside = np.flatnonzero(piece[1:] == piece[:-1])
    inside = inside[inside < here]
    names, total = np.unique(lang, return_counts=True)
    kind = np.repeat(np.array([0, 1, ALL], np.uint64), [here, len(inside), len(names)])
    keys = [np.concatenate([key[:here], key[inside], names]), np.concatenate([lang, key[inside + 1], names]), kind]
    return keys, np.append(np.ones(here + len(inside), np.int64), total)


def _triples(bits: np.ndarray) -> Callable[..., tuple[list[np.ndarray], np.ndarray]]:
    """Triples whose first or last two words may be in the frontier."""

    def tuples(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, own: int) -> tuple[list[np.ndarray], np.ndarray]:
        key, piece, here, _, _ = _keys(data, offsets, langs, own)
        known = _known(bits, _pair_key(key[:-1], key[1:]))
        at = np.flatnonzero((piece[2:] == piece[:-2]) & (known[1:] | known[:-1]))
        at = at[at < here]
        return [key[at], key[at + 1], key[at + 2]], np.ones(len(at), np.int64)

    return tuples


def _spelled(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(word, spelling) of the words that may be in the set ``bits``."""

    def run(batches):
        for batch in batches:
            for data, offsets, langs, own in _chunks(batch):
                key, _, here, begin, end = _keys(data, offsets, langs, own)
                word, at = np.unique(key[:here], return_index=True)
                known = _known(bits, word)
                raw = data.tobytes()
                spelling = [raw[begin[i] : end[i]] for i in at[known]]
                spelling = pa.array(spelling, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(word[known].view(np.int64)), spelling], names=["word", "spelling"])

    return docs.mapInArrow(run, "word long, spelling string").groupBy("word").agg(F.min("spelling").alias("spelling"))


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit per key of a one-column frame, 16 bits a key up to 8 MB; fuller bits let more through, never fewer."""
    size = min(BIT_LIMIT, max(15, (16 * keys.count()).bit_length()))
    at = F.pmod(F.col(keys.columns[0]), F.lit(1 << size)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in maps.collect():
        lo = (r["bucket"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def score(a: str, l: str, r: str) -> str:  # noqa: E741
    """SQL of floor(1000000 * a * a / (l * r)), exact for a < 10^15 and l, r < 10^18."""
    wide = lambda c, n: f"cast({c} as decimal({n}, 0))"
    return f"(cast(1000000 as decimal(7, 0)) * {wide(a, 15)} * {wide(a, 15)}) div ({wide(l, 18)} * {wide(r, 18)})"


def _lowest(cuts: int) -> list[Column]:
    """l, r and score of the lowest cut (ties: shorter first part) from columns l1, r1, l2, r2."""
    each = [F.struct(F.expr(score("a", f"l{k}", f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, cuts + 1)]
    best = F.array_min(F.array(*each))
    return [best[c].alias(c) for c in ("l", "r", "score")]


def _first(phrases: DataFrame, count: int, order: list[Column], place: Column) -> DataFrame:
    """Rows of each language up to ``count``; first per slice, so no task reads a whole language."""
    sliced = phrases.withColumn("_slice", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SLICES)))
    sliced = sliced.withColumn("place", place.over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("place") <= count)
    return sliced.withColumn("place", place.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= count).drop("_slice")


def collocations(
    documents: DataFrame,
    least: int = 10,
    first: int = 2000,
    share: int = 50,
    words: int = 3,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """One row (lang, rank, phrase, a, l, r, n, score) per language and surviving phrase up to ``first``.

    Texts, A-Z in lower case, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. Candidates are phrases of two or three words (``words=2``: two) inside a piece
    with at least ``least`` occurrences (a); l and r are the counts of the parts of the cut that
    scores lowest (ties: shorter first part), n is the language's number of words. A candidate
    inside a longer one that has at least ``share`` percent of its occurrences is dropped. Ranks
    go by score, then a, both falling, then the phrase by bytes.

    A null language is ``und``, null and empty texts hold nothing, repeated rows count each; a
    language without candidates and an empty table give no rows. Columns not named are not read.
    """
    if words not in (2, 3):  # parts of longer phrases would have to be counted outside the frontier
        raise ValueError("phrases have two or three words")
    named = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("name"), F.col(text_col).alias("text"))
    named = named.where(F.length("text") > 0).withColumn("lang", F.xxhash64("name"))
    docs = named.select("lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = cut_lineage(_counted(docs, _words_and_pairs, 3, least, size))
    total = counts.where("w3 = 2").select(F.col("w1").alias("lang"), F.col("f").alias("n"))
    single = counts.where("w3 = 0")
    word = lambda at, f: single.select(F.col("w1").alias(at), F.col("f").alias(f))
    double = counts.where("w3 = 1").select("w1", "w2", "f")
    pairs = double.withColumnRenamed("f", "a").join(single.select("w1", F.col("w2").alias("lang"), F.col("f").alias("l1")), "w1").join(word("w2", "r1"), "w2")
    none = F.lit(None).cast("long")
    bound = F.expr(score("a", "l1", "a")).alias("bound")
    pairs = cut_lineage(pairs.select("lang", "w1", "w2", none.alias("w3"), "a", *_lowest(1), bound))

    falling = [F.desc("score"), F.desc("a")]
    todo, done, take = total.select("lang"), None, 2 * first
    while True:
        last = _first(pairs.join(todo, "lang", "left_semi"), take, [F.desc("score"), "w1", "w2"], F.row_number()).where(F.col("place") == take)
        cut = cut_lineage(todo.join(last.select("lang", F.col("score").alias("cut")), "lang", "left").fillna(0, ["cut"]))
        reached = pairs.join(cut, "lang").where("score >= cut or bound >= cut")
        alive = reached.where("score >= cut").drop("bound", "cut")
        if words == 3:
            reached = cut_lineage(reached)
            alive = reached.where("score >= cut").drop("bound", "cut")
            longer = cut_lineage(_counted(docs, _triples(_bits(reached.select(pair_key("w1", "w2")))), 3, least, size))
            triples = longer.withColumnRenamed("f", "a")
            triples = triples.join(double.select("w1", "w2", F.col("f").alias("l2")), ["w1", "w2"])
            triples = triples.join(double.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1")), ["w2", "w3"])
            triples = triples.join(single.select("w1", F.col("w2").alias("lang"), F.col("f").alias("l1")), "w1").join(word("w3", "r2"), "w3")
            triples = triples.select("lang", "w1", "w2", "w3", "a", *_lowest(2)).join(cut, "lang").where("score >= cut").drop("cut")
            inside = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
            holds = longer.select("f", inside.alias("p")).groupBy("p.w1", "p.w2").agg(F.max("f").alias("held"))
            alive = alive.join(holds, ["w1", "w2"], "left").where(f"held is null or 100 * held < {int(share)} * a").drop("held")
            alive = alive.unionByName(triples)
        alive = cut_lineage(alive)
        enough = alive.groupBy("lang").agg(F.count(F.lit(1)).alias("alive"))
        state = cut.join(enough, "lang", "left").select("lang", ((F.col("cut") == 0) | (F.coalesce("alive", F.lit(0)) >= first)).alias("settled"))
        state = cut_lineage(state)
        found = cut_lineage(_first(alive, first, falling, F.rank()).join(state.where("settled"), "lang", "left_semi"))
        done = found if done is None else done.unionByName(found)
        todo = state.where("not settled").select("lang")
        if todo.isEmpty():
            break
        take *= 4

    # words of what is left, ties at the last place included, then the order by bytes
    wanted = done.select(F.explode(F.array("w1", "w2", "w3")).alias("word")).where("word is not null").distinct()
    spelled = _spelled(docs, _bits(cut_lineage(wanted)))
    spelled = cut_lineage(spelled.join(wanted, "word", "left_semi"))
    out = done.drop("place")
    for w in ("w1", "w2", "w3"):
        out = out.join(spelled.select(F.col("word").alias(w), F.col("spelling").alias(f"s{w}")), w, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", "sw1", "sw2", "sw3"))
    out = _first(out, first, [*falling, F.asc("phrase")], F.row_number()).withColumnRenamed("place", "rank")
    names = named.groupBy("lang").agg(F.min("name").alias("name"))
    out = out.join(total, "lang").join(names, "lang")
    return out.select(F.col("name").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
