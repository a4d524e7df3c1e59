"""Clustering, random-walk embeddings and code similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, blocked_pairs, running_totals
from pathlore.operators.graph import MIXED_HIGH, MIXED_LOW, _arcs
from pathlore.operators.matrix import crosstab
from pathlore.operators.spectral import Pca, pca, pca_scores
from pathlore.session import cut_lineage


def _clusters(vectors: DataFrame, k: int, vec: str, seed: int) -> DataFrame:
    data = vectors.withColumn("_features", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_features")


def kmeans_mixed_rate(vectors: DataFrame, flag: str, ks: tuple[int, ...] = tuple(range(2, 11)), vec: str = "vec", seed: int = 0) -> DataFrame:
    """For each k the share of clusters whose excellent share lies strictly between the mixed limits."""
    parts = None
    for k in ks:
        rates = _clusters(vectors, k, vec, seed).groupBy("cluster").agg(F.avg(F.col(flag).cast("double")).alias("rate"))
        mixed = F.count_if((F.col("rate") > MIXED_LOW) & (F.col("rate") < MIXED_HIGH))
        row = rates.agg(F.lit(k).cast("long").alias("k"), (mixed / k).alias("mixed_rate"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def kmeans_vs_cohort(scored: DataFrame, cohort: str = "cohort", vec: str = "scores", k: int = 2, seed: int = 0) -> DataFrame:
    return crosstab(_clusters(scored, k, vec, seed), cohort, "cluster")


# ---- random walks ---------------------------------------------------------------------------


def _uniform(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from a hash, so a task that runs again takes the same step."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def random_walks(
    edges: DataFrame,
    key: list[str] | None = None,
    length: int = 16,
    per_node: int = 10,
    p: float = 1.0,
    q: float = 1.0,
    seed: int = 0,
    policy: SkewPolicy = DEFAULT,
    row_arcs: int = 512,
) -> DataFrame:
    """Weighted second-order walks: (key, start, walk, path).

    Each node's neighbours own slices of [0, 1); the slices are filed under as many slots as the
    node has neighbours, so a step is an equi-join on (node, slot) that meets about two rows even
    at a hub. A step back, near or away weighs 1/p, 1 and 1/q. For p < 1 the extra weight of the
    way back is drawn first, from the share of that edge; what remains uses rejection, which is
    only needed for p > 1 or q other than 1, and tries again until a step is kept. Without
    rejection the keyed graphs of at most ``row_arcs`` arcs are walked in a row each, by the same
    draws; no walk of theirs is shuffled. The walks are written once, as models read them often.
    """
    key = key or []
    arcs = _arcs(edges.where("w > 0"), key).groupBy(*key, "a", "b").agg(F.sum("w").alias("w"))
    arcs = cut_lineage(arcs)
    size = arcs.groupBy(*key, "a").agg(F.sum("w").alias("tot"), F.count(F.lit(1)).alias("deg"))
    placed = running_totals(arcs, [*key, "a"], ["b"], {"cum": "w"}, policy).join(size, [*key, "a"])
    lo, hi = (F.col("cum") - F.col("w")) / F.col("tot"), F.col("cum") / F.col("tot")
    placed = placed.select(*key, "a", "b", "deg", (F.col("w") / F.col("tot")).alias("share"), lo.alias("lo"), F.when(F.col("cum") >= F.col("tot") * (1 - 1e-12), 1.0).otherwise(hi).alias("hi"))
    rejecting = p > 1 or q != 1
    done = None
    if key and not rejecting:
        large = cut_lineage(arcs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > row_arcs).select(*key))
        if large.isEmpty():
            return cut_lineage(_walks_in_rows(placed, key, length, per_node, p, seed))
        done = _walks_in_rows(placed.join(large, key, "left_anti"), key, length, per_node, p, seed)
        arcs, placed, size = (d.join(large, key, "left_semi") for d in (arcs, placed, size))
    last = F.least(F.floor(F.col("hi") * F.col("deg")), F.col("deg") - 1)
    slots = placed.select(*key, F.col("a").alias("cur"), "b", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * F.col("deg")), last)).alias("slot"))
    slots = cut_lineage(slots)
    degree = size.select(*key, F.col("a").alias("cur"), "deg")
    walkers = size.select(*key, F.col("a").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"))
    walkers = walkers.select("*", F.col("start").alias("cur"), F.lit(None).cast(dict(arcs.dtypes)["a"]).alias("prev"), F.array("start").alias("path"))
    near = arcs.select(*key, F.col("a").alias("prev"), F.col("b"), F.lit(True).alias("_near"))
    shares = cut_lineage(placed.select(*key, F.col("a").alias("cur"), F.col("b").alias("prev"), "share")) if p < 1 else None
    top = max(1.0, 1 / q)

    def propose(w: DataFrame, step: int, attempt: int) -> DataFrame:
        u = _uniform(*[F.col(k) for k in key], F.col("start"), F.col("walk"), F.lit(step), F.lit(attempt), F.lit(seed))
        at = w.join(degree, [*key, "cur"]).withColumn("_u", u).withColumn("slot", F.floor(F.col("_u") * F.col("deg")))
        return at.join(slots, [*key, "cur", "slot"]).where("lo <= _u and _u < hi").drop("lo", "hi", "slot", "deg", "_u")

    for step in range(1, length):
        moved = None
        pending, attempt = walkers, 0
        while True:
            tried = propose(pending, step, attempt)
            named = [F.col(k) for k in key] + [F.col("start"), F.col("walk"), F.lit(step), F.lit(attempt), F.lit(seed)]
            back = F.lit(False)
            if p < 1 and step > 1:
                extra = (1 / p - 1) * F.col("share")
                tried = tried.join(shares, [*key, "cur", "prev"]).withColumn("_back", _uniform(*named, F.lit("back")) < extra / (1 + extra))
                tried = tried.withColumn("b", F.when(F.col("_back"), F.col("prev")).otherwise(F.col("b"))).drop("share")
                back = F.col("_back")
            if rejecting and step > 1:
                alpha = F.when(back, 1.0).when(F.col("b") == F.col("prev"), min(1.0, 1 / p)).when(F.col("_near"), 1.0).otherwise(1 / q)
                keep = _uniform(*named, F.lit("keep")) < alpha / top
                tried = cut_lineage(tried.join(near, [*key, "prev", "b"], "left").withColumn("_ok", keep).drop("_near", "_back"))
                kept = tried.where("_ok").drop("_ok")
                pending = tried.where("not _ok").drop("_ok", "b")
            else:
                kept, pending = tried.drop("_back"), None
            moved = kept if moved is None else moved.unionByName(kept)
            attempt += 1
            if pending is None or pending.isEmpty():
                break
        walkers = moved.select(*key, "start", "walk", F.col("b").alias("cur"), F.col("cur").alias("prev"), F.array_append("path", F.col("b")).alias("path"))
        if step % 4 == 0:
            walkers = cut_lineage(walkers)
    walks = walkers.select(*key, "start", "walk", "path")
    return cut_lineage(walks if done is None else walks.unionByName(done))


def _walks_in_rows(placed: DataFrame, key: list[str], length: int, per_node: int, p: float, seed: int) -> DataFrame:
    """Walks of small graphs: the arcs of a graph are a map in one row, a walk is folded over its draws."""
    ways = placed.groupBy(*key, "a").agg(F.sort_array(F.collect_list(F.struct("hi", "b", "share"))).alias("to"))
    graphs = ways.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("a", "to"))).alias("ways"))
    walkers = graphs.select(*key, "ways", F.explode(F.map_keys("ways")).alias("start"))
    walkers = walkers.select("*", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"))

    def draw(step: Column) -> Column:
        named = [F.col(k) for k in key] + [F.col("start"), F.col("walk"), step, F.lit(0), F.lit(seed)]
        back = _uniform(*named, F.lit("back")) if p < 1 else F.lit(None).cast("double")
        return F.struct(_uniform(*named).alias("u"), back.alias("back"))

    def move(path: Column, drawn: Column) -> Column:
        to = F.element_at("ways", F.element_at(path, -1))
        b = F.get(F.filter(to, lambda way: drawn["u"] < way["hi"]), F.lit(0))["b"]
        if p < 1:
            prev = F.get(path, F.size(path) - 2)  # null before the second step
            extra = (1 / p - 1) * F.get(F.filter(to, lambda way: way["b"] == prev), F.lit(0))["share"]
            b = F.when(drawn["back"] < extra / (1 + extra), prev).otherwise(b)
        return F.concat(path, F.array(b))

    steps = F.slice(F.sequence(F.lit(0), F.lit(length - 1)), 2, length)
    path = F.aggregate(F.transform(steps, draw), F.array("start"), move)
    return walkers.select(*key, "start", "walk", path.alias("path"))


def walk_embedding(
    walks: DataFrame, dim: int = 64, window: int = 8, seed: int = 0, partitions: int | None = None, task_walks: int = 500_000
) -> tuple[DataFrame, Word2VecModel]:
    """Word2Vec over the walks: (node, vec) and the model. A task trains on ``task_walks`` walks, unless
    ``partitions`` is given; their vectors are averaged."""
    partitions = partitions or max(1, -(-walks.count() // task_walks))
    words = walks.select(F.transform("path", lambda n: n.cast("string")).alias("_words"))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, seed=seed, numPartitions=partitions, inputCol="_words", outputCol="_v").fit(words)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vec")), model


def random_walk_embedding(edges: DataFrame, dim: int = 64, length: int = 8, per_node: int = 15, p: float = 1.0, q: float = 1.0, window: int = 8, seed: int = 0) -> DataFrame:
    return walk_embedding(random_walks(edges, None, length, per_node, p, q, seed), dim, window, seed)[0]


def graph_embedding_sum(walks: DataFrame, nodes: DataFrame, by: str = "user_id") -> DataFrame:
    """Per user the sum of the node vectors over all steps of the user's walks."""
    visits = walks.select(by, F.explode("path").alias("node")).groupBy(by, F.col("node").cast("string").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    weighted = visits.join(nodes, "node").select(by, array_to_vector(F.transform("vec", lambda x: x * F.col("n"))).alias("v"))
    return weighted.groupBy(by).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("vec"))


def embedding_2d(vectors: DataFrame, vec: str = "vec") -> tuple[DataFrame, Pca]:
    """First two components of the embeddings as x and y."""
    model = pca(vectors, scaled=False, vec=vec)
    scored = pca_scores(vectors, model, 2, vec)
    return scored.withColumns({"x": F.get("scores", F.lit(0)), "y": F.get("scores", F.lit(1))}).drop("scores", vec), model


# ---- submitted code -------------------------------------------------------------------------


def code_tokens(submissions: DataFrame, text: str = "upload") -> DataFrame:
    """Whitespace runs become one space, the end is trimmed, the first two words are dropped."""
    words = F.split(F.rtrim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    return submissions.withColumn("tokens", F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))))


def code_vectors(tokens: DataFrame, dim: int = 256, kind: str = "tfidf", seed: int = 0) -> DataFrame:
    """One vector per submission: hashed term frequencies with IDF, or the mean word vector."""
    rows = tokens.where(F.size("tokens") > 0)
    if kind == "tfidf":
        counted = HashingTF(numFeatures=dim, inputCol="tokens", outputCol="_tf").transform(rows)
        done = IDF(inputCol="_tf", outputCol="_v").fit(counted).transform(counted).drop("_tf")
    else:
        done = Word2Vec(vectorSize=dim, minCount=1, seed=seed, inputCol="tokens", outputCol="_v").fit(rows).transform(rows)
    return done.withColumn("vec", vector_to_array("_v")).drop("_v")


def user_code_similarity(vectors: DataFrame, block: int = 256, task_slice: int = 64, self_pairs: bool = True) -> DataFrame:
    """Cosine of the joined vectors of all tasks both users did: (u, v, similarity), u <= v.

    ``vectors`` holds one row (user_id, task, vec) per submission. Users are hashed to blocks and
    tasks to slices; a pair of blocks and a slice is one bounded task, however popular a task is,
    and only sums per pair of users leave it.
    """
    size = vectors.agg(F.count_distinct("user_id").alias("u"), F.count_distinct("task").alias("t")).first()
    blocks, slices = max(1, -(-size["u"] // block)), max(1, -(-size["t"] // task_slice))
    kind = dict(vectors.dtypes)["user_id"]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        users, row = np.unique(pdf["user_id"].to_numpy(), return_inverse=True)
        tasks, col = np.unique(pdf["task"].to_numpy(), return_inverse=True)
        vec = np.stack(pdf["vec"].to_numpy())
        x = np.zeros((len(users), len(tasks), vec.shape[1]))
        x[row, col] = vec
        norm = (x * x).sum(axis=2)
        did = np.zeros(norm.shape)
        did[row, col] = 1.0
        flat = x.reshape(len(users), -1)
        home = np.empty(len(users), dtype=np.int64)
        home[row] = pdf["_block"].to_numpy()
        i, j = np.triu_indices(len(users), 0 if self_pairs else 1)
        mine = (np.minimum(home[i], home[j]) == key[0]) & (np.maximum(home[i], home[j]) == key[1])
        i, j = i[mine], j[mine]
        n1 = norm @ did.T
        shared = (did @ did.T)[i, j] > 0
        i, j = i[shared], j[shared]
        return pd.DataFrame({"u": users[i], "v": users[j], "dot": (flat @ flat.T)[i, j], "n1": n1[i, j], "n2": n1[j, i]})

    rows = vectors.select("user_id", F.col("task").cast("string").alias("task"), "vec")
    rows = blocked_pairs(rows, "user_id", blocks).withColumn("_slice", F.pmod(F.xxhash64("task"), F.lit(slices)))
    parts = rows.groupBy("_bi", "_bj", "_slice").applyInPandas(sums, f"u {kind}, v {kind}, dot double, n1 double, n2 double")
    total = parts.groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in ("dot", "n1", "n2")])
    cosine = F.try_divide(F.col("dot"), F.sqrt(F.col("n1") * F.col("n2")))
    return total.select("u", "v", F.coalesce(cosine, F.lit(0.0)).alias("similarity"))


def community_code_similarity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Mean similarity inside each community against all pairs, pooled t."""
    from pathlore.functions.cdf import p_t

    sides = [members.select(F.col("node").alias(c), F.col("community").alias(f"_c{c}")) for c in ("u", "v")]
    inside = pairs.join(sides[0], "u").join(sides[1], "v").where("_cu = _cv")
    stats = [F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("m"), F.var_samp("similarity").alias("s")]
    own = inside.groupBy(F.col("_cu").alias("community")).agg(*stats)
    every = pairs.agg(*stats)
    n0, m0, s0 = (every.select(c).scalar() for c in ("n", "m", "s"))
    pooled = ((n0 - 1) * s0 + (F.col("n") - 1) * F.coalesce("s", F.lit(0.0))) / (n0 + F.col("n") - 2)
    t = (m0 - F.col("m")) / F.sqrt(pooled * (1 / n0 + 1 / F.col("n")))
    out = own.select("community", "n", F.col("m").alias("mean"), t.alias("statistic"), (n0 + F.col("n") - 2).cast("double").alias("df1"))
    return out.withColumn("p_value", p_t(F.col("statistic"), F.col("df1")))
