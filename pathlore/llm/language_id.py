"""Language of words and texts: a linear-chain conditional random field.

Words are maximal runs of letters. A word's features are the byte n-grams of the word between two
marks (those that touch a mark are its affixes), the whole word, and the languages whose lexicon
holds it. Transition weights between the languages of neighbouring words are learned with the
feature weights, on sequences spliced from segments of differently labelled texts. Marginals come
from the forward-backward algorithm; a text's language is the one with the largest mean marginal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlore.llm.spans import BYTE_HASH, Texts, mix, ngram_hash, row_slices, words

UNKNOWN = "und"
FEATURES = 1 << 16
SIZES = (1, 2, 3, 4, 5)  # byte n-grams
LETTERS = re.compile(r"[^\W\d_]+")
SLICE_BYTES = 400_000  # text whose arrays a worker holds at once
SLICES = 64
CHUNK = 64  # words whose transfer matrices are multiplied before texts are walked chunk by chunk


@dataclass(frozen=True)
class Sample:
    """What the model is fitted on: at most ``texts`` labelled texts of each language, in order of a
    hash of the id, and of each at most ``segments`` segments of ``words`` words spread over it."""

    texts: int = 300
    segments: int = 12
    words: int = 10
    lexicon: int = 1000


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (features, languages)
    move: np.ndarray  # (from, to)
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # language of each


def letters(text: str | None) -> list[str]:
    """Lower-case words of a text; none if it has no letter."""
    found = LETTERS.findall(text.lower()) if text else []
    if not any(w.isalpha() for w in found) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def _features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray, lexicon: np.ndarray, member: np.ndarray, langs: int):
    """(feature, word) of every feature of the words ``data[begin:end]``; ``h`` are their hashes."""
    size = end - begin
    wide = size + 2
    first = np.cumsum(wide) - wide
    flat = np.empty(int(wide.sum()), dtype=np.uint8)
    flat[first], flat[first + wide - 1] = 2, 3
    inner = np.repeat(first + 1 - np.cumsum(size) + size, size) + np.arange(size.sum())
    flat[inner] = data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
    owner = np.repeat(np.arange(len(begin)), wide)
    value = BYTE_HASH[flat]
    out, mine = [(mix(h) & np.uint64(FEATURES - 1)).astype(np.int64)], [np.arange(len(begin))]
    for n in SIZES:
        grams = ngram_hash(value, n)
        inside = owner[: len(grams)] == owner[n - 1 :]
        out.append((mix(grams[inside] + np.uint64(n)) & np.uint64(FEATURES - 1)).astype(np.int64))
        mine.append(owner[: len(grams)][inside])
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = np.flatnonzero(lexicon[at] == h)
        out.append(FEATURES + member[at[hit]])
        mine.append(hit)
    return np.concatenate(out), np.concatenate(mine)


def _scores(feature: np.ndarray, word: np.ndarray, count: int, weight: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(word, weights=weight[feature, k], minlength=count) for k in range(weight.shape[1])])


def fit(documents: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: Sample = Sample(), rounds: int = 40) -> Model:
    """A model from the labelled rows of ``documents``; rows with null language or text are left out."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # first per slice of a language, so that the last step reads at most SLICES * sample.texts ids of each
    ids = rows.select(id_col, lang_col, F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(SLICES)).alias("_slice"))
    for part in ([lang_col, "_slice"], [lang_col]):
        order = Window.partitionBy(*part).orderBy(F.xxhash64(id_col), id_col)
        ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample.texts)
    chosen = rows.select(id_col, lang_col, text_col).join(F.broadcast(ids.select(id_col, lang_col)), [id_col, lang_col])

    def cut(batches):
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = letters(text)
                starts = range(0, max(1, len(found) - sample.words + 1), sample.words)
                step = -(-len(starts) // sample.segments)
                for at in starts[::step]:
                    if found:
                        langs.append(lang)
                        parts.append(" ".join(found[at : at + sample.words]))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.string())})

    taken = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(cut, "lang string, part string")
    found = sorted(map(tuple, taken.collect()))
    return _fit([f[1] for f in found], [f[0] for f in found], sample, rounds)


def _fit(parts: list[str], langs_of: list[str], sample: Sample, rounds: int) -> Model:
    langs = sorted(set(langs_of))
    n_langs = len(langs)
    if not n_langs:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((0, 0)), np.zeros(0), np.empty(0, np.uint64), np.empty(0, np.int64))
    random = np.random.default_rng(7)
    label = np.array([langs.index(x) for x in langs_of])
    by_lang = [np.flatnonzero(label == k) for k in range(n_langs)]
    # sequences of four segments; a segment keeps the language of the one before it every second time
    sequences = len(parts) // 4 + 1
    order = []
    for _ in range(sequences):
        lang = random.integers(n_langs)
        for _ in range(4):
            if random.random() < 0.5:
                lang = random.integers(n_langs)
            order.append(by_lang[lang][random.integers(len(by_lang[lang]))])
    text = [parts[i] for i in order]
    texts = Texts(pa.array(text))
    begin, end, first, h = words(texts.data, texts.offsets)
    gold = np.repeat(label[order], np.diff(first))
    length = np.diff(first).reshape(sequences, 4).sum(axis=1)
    keys, times = np.unique(h, return_counts=True)
    per = np.array([np.bincount(np.searchsorted(keys, h[gold == k]), minlength=len(keys)) for k in range(n_langs)])
    lexicon, member = [], []
    for k in range(n_langs):
        own = np.flatnonzero((per[k] >= 2) & (per[k] >= 0.8 * times))
        own = own[np.argsort(-per[k][own], kind="stable")][: sample.lexicon]
        lexicon.append(keys[own])
        member.append(np.full(len(own), k))
    lexicon, member = np.concatenate(lexicon), np.concatenate(member)
    by_hash = np.argsort(lexicon)
    lexicon, member = lexicon[by_hash], member[by_hash]
    feature, word = _features(texts.data, begin, end, h, lexicon, member, n_langs)

    longest = int(length.max())
    place = np.full((sequences, longest), -1, dtype=np.int64)
    for i, at in enumerate(np.append(0, np.cumsum(length))[:-1]):
        place[i, : length[i]] = np.arange(at, at + length[i])
    real = place >= 0
    step_mask = real[:, 1:]
    weight, move, start = np.zeros((FEATURES + n_langs, n_langs)), np.zeros((n_langs, n_langs)), np.zeros(n_langs)
    square = [np.full_like(x, 1e-8) for x in (weight, move, start)]
    truth = np.eye(n_langs)[gold]
    pairs = np.zeros((n_langs, n_langs))
    np.add.at(pairs, (gold[place[:, :-1][step_mask]], gold[place[:, 1:][step_mask]]), 1)
    for _ in range(rounds):
        score = _scores(feature, word, len(gold), weight)
        padded = np.where(real[:, :, None], score[np.maximum(place, 0)], 0.0)
        local = np.exp(padded - padded.max(axis=2, keepdims=True))
        jump = np.exp(move)
        alpha, beta = np.empty_like(local), np.ones_like(local)
        now = np.exp(start) * local[:, 0]
        alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            now = (alpha[:, t - 1] @ jump) * local[:, t]
            alpha[:, t] = np.where(real[:, t, None], now / now.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            now = (beta[:, t + 1] * local[:, t + 1]) @ jump.T
            beta[:, t] = np.where(real[:, t + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        both = alpha[:, :-1, :, None] * jump * (local[:, 1:] * beta[:, 1:])[:, :, None, :]
        both /= both.sum(axis=(2, 3), keepdims=True)
        error = gamma[real][np.argsort(place[real])] - truth
        slope = np.column_stack([np.bincount(feature, weights=error[word, k], minlength=len(weight)) for k in range(n_langs)])
        begins = gamma[:, 0].sum(axis=0) - truth[place[:, 0]].sum(axis=0)
        for x, s, g in zip((weight, move, start), square, (slope + 0.5 * weight, both[step_mask].sum(axis=0) - pairs, begins + start)):
            s += g * g
            x -= 0.3 * g / np.sqrt(s)
    return Model(langs, weight, move, start, lexicon, member)


def _marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over many texts: marginals (words, languages); ``first`` are text offsets.

    Texts are cut into chunks of words. Each chunk's transfer matrix is multiplied up side by
    side, texts are then walked chunk by chunk, and the words inside follow.
    """
    total, k = score.shape
    local = np.exp(score - score.max(axis=1, keepdims=True)) if total else score
    jump, begin = np.exp(move), np.exp(start)
    length = np.diff(first)
    per_text = -(-length // CHUNK)
    chunk_first = np.append(0, np.cumsum(per_text))
    chunks = int(chunk_first[-1])
    text = np.repeat(np.arange(len(length)), per_text)
    order = np.arange(chunks) - chunk_first[text]
    at = first[text] + order * CHUNK
    size = np.minimum(CHUNK, first[text + 1] - at)
    opens = order == 0
    place = np.minimum(at[:, None] + np.arange(CHUNK), total - 1)
    real = np.arange(CHUNK) < size[:, None]
    e = local[place]
    transfer = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
    for t in range(CHUNK):
        now = (transfer.reshape(-1, k) @ jump).reshape(chunks, k, k) * e[:, t, None, :]
        if t == 0:
            now[opens] = (begin * e[opens, 0])[:, None, :]
        now /= now.max(axis=(1, 2), keepdims=True)
        transfer = np.where(real[:, t, None, None], now, transfer)
    into, behind = np.ones((chunks, k)), np.ones((chunks, k))
    for c in range(1, int(per_text.max(initial=0))):
        mine = np.flatnonzero(order == c)
        now = np.einsum("ni,nij->nj", into[mine - 1], transfer[mine - 1])
        into[mine] = now / now.sum(axis=1, keepdims=True)
    for c in range(int(per_text.max(initial=0)) - 2, -1, -1):
        mine = np.flatnonzero((order == c) & (c + 1 < per_text[text]))
        now = np.einsum("nij,nj->ni", transfer[mine + 1], behind[mine + 1])
        behind[mine] = now / now.sum(axis=1, keepdims=True)
    alpha, now = np.empty((chunks, CHUNK, k)), into
    for t in range(CHUNK):
        step = (now @ jump) * e[:, t]
        if t == 0:
            step[opens] = begin * e[opens, 0]
        now = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), now)
        alpha[:, t] = now
    beta, now = np.empty((chunks, CHUNK, k)), behind
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = now
        step = (now * e[:, t]) @ jump.T
        now = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), now)
    gamma = (alpha * beta)[real]
    return gamma / gamma.sum(axis=1, keepdims=True)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, lang_pred, score, parts, sure, ``carry``) per row of ``documents``; only the text is read.

    ``lang_pred`` is the language with the largest mean marginal over all words (ties: the first
    by name), ``score`` that mean; ``parts`` are the runs (lang, words) of the most probable
    language of each word, ``sure`` the mean over the words of that language's marginal. Null texts and texts without a letter are ``und`` with score 0, as
    are all texts if the model has no language. A null id stays null, repeated rows repeat.
    """
    langs = model.langs

    def run(batches):
        for batch in batches:
            for lo, hi in row_slices(batch.column(text_col), SLICE_BYTES):
                found = [letters(t) for t in batch.column(text_col).slice(lo, hi - lo).to_pylist()] if langs else [[] for _ in range(lo, hi)]
                first = np.append(0, np.cumsum([len(f) for f in found]))
                name, score = np.array([UNKNOWN] * (hi - lo), dtype=object), np.zeros(hi - lo)
                sure = np.zeros(hi - lo)
                edges, kinds, sizes = np.zeros(hi - lo + 1, np.int64), [], np.empty(0, np.int64)
                if first[-1]:
                    raw = Texts(pa.array([" ".join(w for f in found for w in f)]))
                    begin, end, _, h = words(raw.data, raw.offsets)
                    keys, at, where = np.unique(h, return_index=True, return_inverse=True)
                    feature, word = _features(raw.data, begin[at], end[at], keys, model.lexicon, model.member, len(langs))
                    emission = _scores(feature, word, len(keys), model.weight)[where]
                    gamma = _marginals(emission, first, model.move, model.start)
                    full = np.flatnonzero(np.diff(first))
                    mean = np.add.reduceat(gamma, first[full], axis=0) / np.diff(first)[full, None]
                    name[full] = [langs[i] for i in mean.argmax(axis=1)]
                    score[full] = np.clip(mean.max(axis=1), 0, 1)
                    sure[full] = np.clip(np.add.reduceat(gamma.max(axis=1), first[full]) / np.diff(first)[full], 0, 1)
                    best = gamma.argmax(axis=1)
                    new = np.append(True, best[1:] != best[:-1])
                    new[first[full]] = True
                    runs = np.flatnonzero(new)
                    kinds, sizes = [langs[i] for i in best[runs]], np.diff(np.append(runs, len(best)))
                    edges = np.searchsorted(runs, first)
                parts = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(sizes, pa.int64())], names=["lang", "words"])
                part = batch.slice(lo, hi - lo)
                columns = {id_col: part.column(id_col), "lang_pred": pa.array(name, pa.string()), "score": pa.array(score)}
                columns["parts"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts)
                columns["sure"] = pa.array(sure)
                yield pa.RecordBatch.from_pydict(columns | {c: part.column(c) for c in carry})
            pa.default_memory_pool().release_unused()

    kinds = dict(documents.dtypes)
    schema = [f"`{id_col}` {kinds[id_col]}", "lang_pred string", "score double", "parts array<struct<lang: string, words: long>>", "sure double"]
    schema += [f"`{c}` {kinds[c]}" for c in carry]
    return documents.select(*dict.fromkeys([id_col, text_col, *carry])).mapInArrow(run, ", ".join(schema))
