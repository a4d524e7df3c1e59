"""Near-duplicate texts by chosen paths: a recursive set similarity join on minwise tokens.

Every distinct set of word n-grams carries ``HASHES`` minwise tokens. A tree starts with all sets in
one node. A node picks tokens by its own hash, one always and a second with probability
1/similarity - 1, and passes every set to the child that its value of the token names; so a pair
at the threshold shares one child on average. Nodes of few sets are compared exhaustively: the
tokens drop pairs far below the threshold, what is left is counted on the full sets. Trees
are independent and repeat until a pair at the threshold would be missed with probability of
at most 1 - recall, by the depth that the trees had.

Sets of one component need no more comparisons: a node is followed only while it holds several
components. A first look at one level of a tree cuts its large nodes into blocks that share a few
centres, so large groups of copies are one component before any tree goes deep.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.components import components, in_few_tasks, merged
from pathlore.llm.ngram_join import _batches, _bitmap, _sets
from pathlore.llm.spans import mix
from pathlore.session import cut_lineage

HASHES = 64
LEAF, GRAMS = 1024, 500_000  # sets and n-grams of a node that is compared exhaustively
FEW = 8  # sets compared exhaustively whatever their size
FIRST = 4  # levels of a tree before the first look at the sizes of its nodes
STEP = 2  # levels between two further looks
DEPTH = 64  # levels after which nodes are compared block by block instead of followed
CENTRES = 3  # sets that all blocks of a node share
TASK_ROWS, TASK_GRAMS = 10_000, 1_000_000  # of a task that compares several nodes
SALTS = 16
_RANDOM = np.random.default_rng(1303)
_FACTOR = _RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Per text: id, number of n-grams, hash of the set, minwise tokens and a byte of each."""

    def run(batches):
        for batch in batches:
            for texts, lo, hi in _batches(batch, "text"):
                text, gram, _, _ = _sets(texts, lo, hi, n)
                edges = np.searchsorted(text, np.arange(hi - lo + 1))
                total = np.append(np.uint64(0), np.cumsum(mix(gram)))
                size = np.diff(edges)
                key = mix(np.diff(total[edges]) + size.astype(np.uint64))
                tokens = np.zeros((hi - lo, HASHES), np.uint32)
                full = np.flatnonzero(size)
                if len(full):
                    short = (mix(gram) >> np.uint64(32)).astype(np.uint32)
                    for i in range(HASHES):
                        tokens[full, i] = np.minimum.reduceat(short * _FACTOR[i] + _ADD[i], edges[full])
                marks = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(lo, hi - lo),
                        "n": pa.array(size.astype(np.int64)),
                        "key": pa.array(key.view(np.int64)),
                        "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
                        "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
                    }
                )

    return cut_lineage(docs.mapInArrow(run, "id long, n long, key long, tokens binary, marks binary"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, HASHES)


def _children(nodes: np.ndarray, tokens: np.ndarray, row: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(child, place in ``nodes``) of every node; ``row`` is the row of ``tokens`` of each."""
    out, mine = [], []
    pick = mix(nodes ^ np.uint64(0xA0761D6478BD642F))
    chosen = pick % np.uint64(HASHES)
    other = (chosen + np.uint64(1) + (pick >> np.uint64(32)) % np.uint64(HASHES - 1)) % np.uint64(HASHES)
    both = np.flatnonzero((mix(pick) >> np.uint64(11)).astype(np.float64) / 2.0**53 < second)
    for at, token in ((np.arange(len(nodes)), chosen), (both, other)):
        t = token[at].astype(np.int64)
        value = tokens[row[at], t].astype(np.uint64) | (token[at] << np.uint64(32))
        out.append(mix(mix(nodes[at]) + mix(value + np.uint64(1))))
        mine.append(at)
    return np.concatenate(out), np.concatenate(mine)


def _descend(rows: DataFrame, roots: list[int] | None, second: float, levels: int) -> DataFrame:
    """(node, key, n, label) ``levels`` below ``rows`` (node, key, n, label, tokens), or below new ``roots``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32)
            if roots is None:
                nodes, row = batch.column("node").to_numpy().view(np.uint64), np.arange(batch.num_rows)
            else:
                nodes = np.repeat(mix(np.array(roots, dtype=np.uint64)), batch.num_rows)
                row = np.tile(np.arange(batch.num_rows), len(roots))
            for _ in range(levels):
                nodes, at = _children(nodes, tokens, row, second)
                row = row[at]
            rest = batch.select(["key", "n", "label"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *rest.columns], names=["node", "key", "n", "label"])

    return cut_lineage(rows.mapInArrow(run, "node long, key long, n long, label long"))


def _open(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that hold several components, with the node's size and whether it is small; size and centres of large nodes.

    Of small nodes with the same sets one is kept, as they are compared exhaustively. ``most`` is about the number of ``rows``.
    """
    centre = lambda salt: F.min(F.struct(F.xxhash64("key", F.lit(salt)), "key", "n", "label"))
    content = [F.bit_xor(F.xxhash64("key", F.lit(salt))).alias(f"content{salt}") for salt in range(2)]
    sizes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"), F.min("label").alias("least"), F.max("label").alias("most"), *content
    )
    sizes = sizes.where("least < most").withColumn("small", (F.col("sets") <= FEW) | ((F.col("sets") <= LEAF) & (F.col("grams") <= GRAMS)))
    same = [F.when(F.col("small"), F.col(f"content{salt}")).otherwise(F.col("node")).alias(f"content{salt}") for salt in range(2)]
    sizes = sizes.groupBy("sets", "grams", "small", *same).agg(F.min("node").alias("node"))
    held = cut_lineage(in_few_tasks(rows.join(sizes.select("node", "sets", "grams", "small"), "node"), most))
    size = [F.max("sets").alias("sets"), F.max("grams").alias("grams")]
    large = held.where("not small").groupBy("node").agg(*size, F.array(*[centre(s) for s in range(CENTRES)]).alias("centres"))
    return held, large


def _blocks(large: DataFrame, centres: DataFrame) -> DataFrame:
    """(node, key, n, label) of blocks of large nodes; all blocks of a node hold its centres."""
    parts = F.ceil(F.greatest(F.col("sets") / (LEAF - CENTRES), F.col("grams") / GRAMS) * 1.2)
    part = F.pmod(F.xxhash64("key", F.lit(77)), parts)
    own = large.select(F.xxhash64("node", part).alias("block"), "key", "n", "label")
    each = centres.select("node", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "centres")
    shared = each.select(F.xxhash64("node", "part").alias("block"), F.explode("centres").alias("c")).select("block", "c.key", "c.n", "c.label")
    return own.union(shared).distinct().withColumnRenamed("block", "node")


def _block_pairs(large: DataFrame) -> DataFrame:
    """(node, key, n, label) of all pairs of blocks of large nodes: an exhaustive comparison in bounded parts."""
    parts = F.ceil(F.greatest(F.col("sets") / (LEAF / 2), F.col("grams") / (GRAMS / 2)) * 1.2)
    part = F.pmod(F.xxhash64("key", F.lit(78)), F.col("parts"))
    with_all = large.withColumn("parts", parts).withColumn("part", part)
    with_all = with_all.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other"))
    return with_all.select(pair.alias("node"), "key", "n", "label").distinct()


def _by_task(df: DataFrame, weight: str, most: int, fold: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fold`` over whole nodes, many to a task: rows are dealt by a hash of the node."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    dealt = df.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(int(total // most) + 1)))
    return dealt.groupBy("task").applyInArrow(lambda t: fold(t), schema)


def _edges(nodes: np.ndarray) -> np.ndarray:
    """Borders of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]])) if len(nodes) else np.zeros(1, np.int64)


def _near(table: pa.Table, percent: int) -> pa.Table:
    """(node, key, id, n, label) of the sets of each node that may link to one of another component, by their tokens.

    Sets that are connected this way keep together under a name made of their keys, so that
    the same sets met in several trees are compared once. A pair at the threshold fails here
    with probability of about 10^-6.
    """
    table = table.sort_by([("node", "ascending"), ("key", "ascending")])
    node, key, label, size, rep = (table.column(c).to_numpy() for c in ("node", "key", "label", "n", "id"))
    marks = _matrix(table.column("marks"), np.uint8)
    share = percent / 100
    enough = np.floor(HASHES * share - 5 * np.sqrt(HASHES * share * (1 - share)))
    edges = _edges(node)
    stop = np.repeat(edges[1:], np.diff(edges))
    later = stop - np.arange(len(node)) - 1
    total = np.append(0, np.cumsum(later))
    left, right, lo = [], [], 0
    while lo < len(node):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 100_000, side="right")) - 1)
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], later[lo:hi])
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        able = (label[a] != label[b]) & (key[a] != key[b]) & (100 * small >= percent * large)
        a, b = a[able], b[able]
        alike = (marks[a] == marks[b]).sum(axis=1) >= enough
        left.append(a[alike])
        right.append(b[alike])
        lo = hi
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    group = np.arange(len(node))
    while len(a):
        least = np.minimum(group[a], group[b])
        new = group.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == group).all():
            break
        group = new
    some = np.unique(np.concatenate([a, b]))
    order = some[np.argsort(group[some], kind="stable")]
    borders = _edges(group[order])
    name = np.add.reduceat(mix(mix(key[order].view(np.uint64))), borders[:-1]) if len(order) else np.empty(0, np.uint64)
    name = np.repeat(mix(name), np.diff(borders)).view(np.int64) if len(order) else name.view(np.int64)
    return pa.table({c: pa.array(x) for c, x in (("node", name), ("key", key[order]), ("id", rep[order]), ("n", size[order]), ("label", label[order]))})


def _confirmed(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between the components of each node by the full sets, one per pair."""
    table = table.sort_by([("node", "ascending"), ("key", "ascending")])
    node, label = (table.column(c).to_numpy() for c in ("node", "label"))
    raw = table.column("grams")
    edges, out = _edges(node), [[], []]
    for lo, hi in zip(edges[:-1], edges[1:]):
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in range(lo, hi)]
        size = np.array([len(s) for s in sets])
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        column, row = code[shared], np.repeat(np.arange(hi - lo), size)[shared]
        column = np.unique(column, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        both = np.zeros((hi - lo, hi - lo), np.float32)
        width = max(256, 4_000_000 // (hi - lo))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s = slice(*np.searchsorted(column, [first, first + width]))
            x = np.zeros((hi - lo, min(width, int(column[-1]) + 1 - first)), np.float32)
            x[row[s], column[s] - first] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        union = size[:, None] + size[None, :] - both
        names = label[lo:hi]
        i, j = np.nonzero(np.triu((100 * both >= percent * union) & (both > 0) & (names[:, None] != names[None, :]), 1))
        pair = np.sort(np.column_stack([names[i], names[j]]), axis=1)
        pair = np.unique(pair, axis=0)
        out[0].append(pair[:, 0])
        out[1].append(pair[:, 1])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _with_sets(docs: DataFrame, n: int, wanted: DataFrame, sets: int) -> DataFrame:
    """(key, grams) of the sets ``wanted`` (id, key), at most ``sets``: their sorted n-gram hashes.

    Texts whose id is not in a bitmap of the wanted ids are not hashed. Several texts may share
    an id; the key tells which is meant.
    """
    wanted = cut_lineage(in_few_tasks(wanted, sets))
    bitmap = _bitmap(wanted.select("id"), wanted.count())

    def run(batches):
        last = np.uint64(len(bitmap) * 8 - 1)
        for batch in batches:
            at = (mix(batch.column("id").to_numpy().view(np.uint64)) & last).astype(np.int64)
            batch = batch.filter(pa.array((bitmap[at >> 3] >> (7 - (at & 7))) & 1 == 1))
            for texts, lo, hi in _batches(batch, "text"):
                text, gram, _, _ = _sets(texts, lo, hi, n)
                edges = np.searchsorted(text, np.arange(hi - lo + 1))
                total = np.append(np.uint64(0), np.cumsum(mix(gram)))
                key = mix(np.diff(total[edges]) + np.diff(edges).astype(np.uint64))
                blobs = [gram[edges[i] : edges[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column("id").slice(lo, hi - lo), "key": pa.array(key.view(np.int64)), "grams": pa.array(blobs, pa.binary())}
                )

    found = docs.mapInArrow(run, "id long, key long, grams binary")
    return found.join(wanted, ["id", "key"], "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))


def survival(depth: int, percent: int) -> float:
    """Probability that a pair at the threshold still shares a node at ``depth``."""
    share = percent / 100
    second, lost = 1 / share - 1, 0.0
    for _ in range(depth):
        lost = (1 - share * (1 - lost)) * (1 - second * share * (1 - lost))
    return 1 - lost


def near_duplicates(
    documents: DataFrame,
    percent: int = 85,
    recall: float = 0.9999,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_gram: int = 5,
    trees: int = 16,
) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per row of ``documents``.

    A text's set is its distinct n-grams of words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a
    text with fewer words has one, its whole sequence. Null texts and texts without words have
    none, link with nothing and are their own component. Two texts link if 100 times the
    intersection reaches ``percent`` times the union, counted on full sets of 64-bit hashes;
    ``component_id`` is the smallest id reachable, ``kept`` says that it is the row's own.

    No wrong link is made. A link at the threshold is found with probability ``recall`` at
    least, more alike pairs with more; equal sets always. Trees run ``trees`` at a time.
    Rows that share an id are separate texts. A row with a null id takes no part and has a
    null component and ``kept``. Columns not named are not read.
    """
    second = 100 / percent - 1
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = _profile(docs, words_per_gram)
    known = texts.where("id is not null and n > 0")
    classes = known.groupBy("key", "n").agg(
        F.min("id").alias("rep"), F.max("id").alias("most"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks")
    )
    classes = cut_lineage(classes)
    named = docs.where("id is not null")
    labels, seen = classes.select(F.col("key").alias("node"), F.col("key").alias("label")).where("false"), None
    missed, used, looked, sets = 1.0, 0, False, classes.count()

    while missed > 1 - recall:
        roots = list(range(used, used + (trees if looked else 1)))
        start = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        depth, most = FIRST if looked else 1, sets * len(roots)
        rows, groups = _descend(start.select("key", "n", "label", "tokens"), roots, second, depth), None
        while True:
            held, centres = _open(rows, most)
            here = held.where("small").select("node", "key", "n", "label")
            large = held.where("not small")
            more = not large.isEmpty()
            if more and not looked:
                here, more = here.union(_blocks(large, centres)), False
            elif more and depth >= DEPTH:
                here, more = here.union(_block_pairs(large)), False
            groups = here if groups is None else groups.union(here)
            if not more:
                break
            rows = _descend(large.join(classes.select("key", "tokens"), "key").select("node", "key", "n", "label", "tokens"), None, second, STEP)
            depth += STEP
        if looked:
            missed *= (1 - survival(depth, percent)) ** len(roots)
            used += len(roots)
        looked = True
        with_marks = cut_lineage(in_few_tasks(groups.join(classes.select("key", "marks", F.col("rep").alias("id")), "key"), most))
        near = _by_task(with_marks.withColumn("one", F.lit(1)), "one", TASK_ROWS, lambda t: _near(t, percent), "node long, key long, id long, n long, label long")
        near = near.distinct()
        near = cut_lineage(in_few_tasks(near if seen is None else near.join(seen, "node", "left_anti"), most))
        if not near.isEmpty():
            full = cut_lineage(near.drop("id").join(_with_sets(named, words_per_gram, near.select("id", "key").distinct(), sets), "key"))
            found = cut_lineage(_by_task(full, "n", TASK_GRAMS, lambda t: _confirmed(t, percent), "a long, b long"))
            if not found.isEmpty():
                labels = merged(labels, found) if seen is not None else cut_lineage(components(found))
            if missed > 1 - recall:
                names = near.select("node").distinct()
                seen = cut_lineage(in_few_tasks(names, most) if seen is None else seen.union(in_few_tasks(names, most)))

    named_labels = classes.select("key", "rep", "most").join(labels.withColumnRenamed("node", "key"), "key", "left")
    least = named_labels.where("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    found = named_labels.join(least, "label", "left").where("least is not null or most > rep")
    found = found.select("key", F.coalesce("least", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = texts.select("id", "n", "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = salted.join(found, ["key", "salt"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
