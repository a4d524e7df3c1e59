"""Petri nets: the alpha miner's places from a footprint, and token replay of a log.

A net is a table of places (place, inputs, outputs): the activities that put a token into the place
and those that take one. The place ``start`` holds a token when a case begins and ``end`` gives
one up when it is over. Places don't touch each other in a replay that forces every event, so each
(case, place) is a running sum of tokens; what has to be added is its lowest point below zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, running_totals, with_next, with_position
from pathlore.operators.matrix import ORDER
from pathlore.session import cut_lineage

START, END = "start", "end"


def footprint(edges: DataFrame) -> DataFrame:
    """(src, dst, relation) of all ordered pairs with an edge: ``causal`` one way, ``reverse``, ``parallel``."""
    one = edges.select("src", "dst").distinct()
    back = one.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(1).alias("_back"))
    both = one.join(back, ["src", "dst"], "left")
    there = both.select("src", "dst", F.when(F.col("_back").isNull(), "causal").otherwise("parallel").alias("relation"))
    rest = both.where("_back is null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("reverse").alias("relation"))
    return there.unionByName(rest)


def case_ends(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """(activity, starts, ends): cases that begin and end with each activity that does either."""
    nexts = with_position(with_next(log, ["case_id"], ORDER, {"_after": "activity"}, policy), ["case_id"], ORDER, "_pos", policy)
    first, last = (F.col("_pos") == 1).cast("long"), F.col("_after").isNull().cast("long")
    ends = nexts.groupBy("activity").agg(F.sum(first).alias("starts"), F.sum(last).alias("ends"))
    return ends.where("starts > 0 or ends > 0")


def alpha_net(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Places of the alpha miner: maximal pairs of activity sets (inputs, outputs), every input causal
    to every output, no two inputs and no two outputs (nor one with itself) in any relation.

    ``ends`` is the table of ``case_ends``. Pairs grow by one activity a round, all at once, from
    the causal pairs; a pair that nothing extends is a place, named by its sets. The number of
    rounds is that of the activities around the largest place.
    """
    relations = cut_lineage(footprint(edges))
    related = relations.groupBy("src").agg(F.collect_set("dst").alias("related"))
    loops = relations.where("src = dst").select("src")
    after = relations.where("relation = 'causal'").groupBy("src").agg(F.collect_set("dst").alias("after"))
    before = relations.where("relation = 'causal'").groupBy(F.col("dst").alias("src")).agg(F.collect_set("src").alias("before"))
    facts = related.join(loops, "src", "left_anti").join(after, "src", "left").join(before, "src", "left")
    none = F.array().cast("array<string>")
    facts = cut_lineage(facts.select(F.col("src").alias("x"), "related", F.coalesce("after", none).alias("after"), F.coalesce("before", none).alias("before")))
    plain = facts.select("x")
    causal = relations.where("relation = 'causal'").join(plain.withColumnRenamed("x", "src"), "src").join(plain.withColumnRenamed("x", "dst"), "dst")
    frontier = cut_lineage(causal.select(F.array("src").alias("inputs"), F.array("dst").alias("outputs")))
    places = None
    while not frontier.isEmpty():
        # the first output's causes and the first input's effects are the only activities that can join
        causes, effects = (facts.select("x", "related", c, F.explode(c).alias("_near")) for c in ("after", "before"))
        more_in = frontier.join(causes, F.col("outputs")[0] == F.col("_near")).where(
            (F.size(F.array_except("outputs", "after")) == 0) & (F.size(F.array_intersect("inputs", "related")) == 0) & ~F.array_contains("inputs", F.col("x"))
        )
        more_out = frontier.join(effects, F.col("inputs")[0] == F.col("_near")).where(
            (F.size(F.array_except("inputs", "before")) == 0) & (F.size(F.array_intersect("outputs", "related")) == 0) & ~F.array_contains("outputs", F.col("x"))
        )
        grown = more_in.select("inputs", "outputs", F.array_sort(F.array_append("inputs", F.col("x"))).alias("in2"), F.col("outputs").alias("out2"))
        grown = grown.unionByName(more_out.select("inputs", "outputs", F.col("inputs").alias("in2"), F.array_sort(F.array_append("outputs", F.col("x"))).alias("out2")))
        grown = cut_lineage(grown)
        done = frontier.join(grown.select("inputs", "outputs").distinct(), ["inputs", "outputs"], "left_anti")
        places = done if places is None else places.unionByName(done)
        frontier = cut_lineage(grown.select(F.col("in2").alias("inputs"), F.col("out2").alias("outputs")).distinct())
    name = F.concat(F.array_join("inputs", "+"), F.lit(">"), F.array_join("outputs", "+"))
    outer = ends.agg(
        F.array_sort(F.collect_set(F.when(F.col("starts") > 0, F.col("activity")))).alias("first"),
        F.array_sort(F.collect_set(F.when(F.col("ends") > 0, F.col("activity")))).alias("last"),
    )
    source = outer.select(F.lit(START).alias("place"), none.alias("inputs"), F.col("first").alias("outputs"))
    sink = outer.select(F.lit(END).alias("place"), F.col("last").alias("inputs"), none.alias("outputs"))
    net = source.unionByName(sink)
    return net if places is None else net.unionByName(places.select(name.alias("place"), "inputs", "outputs"))


def token_replay(log: DataFrame, net: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """(case_id, produced, consumed, missing, remaining, fitness) of every case.

    Every event fires: a token that a place lacks is added and counted as missing. A case's first
    token in ``start`` counts as produced, the one taken from ``end`` as consumed. Fitness is
    (1 - missing / consumed) / 2 + (1 - remaining / produced) / 2. Activities that the net does
    not know move no token. A case of any length is folded by running sums, by ranges if it is
    longer than a task should hold.
    """
    takes = net.select("place", F.explode("outputs").alias("activity"), F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("_t"))
    gives = net.select("place", F.explode("inputs").alias("activity"), F.lit(1).alias("_side"), F.lit(1).cast("long").alias("_t"))
    moves = log.select("case_id", *ORDER, "activity").join(takes.unionByName(gives), "activity")
    moves = cut_lineage(moves.select("case_id", "place", *ORDER, "_side", "_t"))
    summed = running_totals(moves, ["case_id", "place"], [*ORDER, "_side"], {"_held": "_t"}, policy)
    first = F.when(F.col("place") == START, 1).otherwise(0)
    last = F.when(F.col("place") == END, 1).otherwise(0)
    per_place = summed.groupBy("case_id", "place").agg(F.min("_held").alias("_low"), F.sum("_t").alias("_net"), F.sum(F.when(F.col("_t") > 0, 1).otherwise(0)).alias("_given"), F.sum(F.when(F.col("_t") < 0, 1).otherwise(0)).alias("_taken"))
    # cases that never touch the first or the last place still begin with a token and owe one
    owed = log.select("case_id").distinct().withColumn("place", F.explode(F.array(F.lit(START), F.lit(END))))
    per_place = owed.join(per_place, ["case_id", "place"], "full").na.fill(0, ["_low", "_net", "_given", "_taken"])
    given, taken = F.col("_given") + first, F.col("_taken") + last
    low = F.least(F.col("_low") + first, F.col("_net") + first - last, F.lit(0))
    missing = -low
    per_place = per_place.select("case_id", given.alias("p"), taken.alias("c"), missing.alias("m"), (F.col("_net") + first - last + missing).alias("r"))
    cases = per_place.groupBy("case_id").agg(*[F.sum(a).cast("long").alias(b) for a, b in (("p", "produced"), ("c", "consumed"), ("m", "missing"), ("r", "remaining"))])
    return cases.withColumn("fitness", _fitness(F.col("produced"), F.col("consumed"), F.col("missing"), F.col("remaining")))


def _fitness(produced, consumed, missing, remaining):
    return F.lit(1.0) - F.coalesce(F.try_divide(missing, consumed), F.lit(0.0)) / 2 - F.coalesce(F.try_divide(remaining, produced), F.lit(0.0)) / 2


def replay_fitness(log: DataFrame, net: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """One row: tokens over all cases, the log's fitness and the share of cases that fit without fault."""
    cases = token_replay(log, net, policy)
    sums = cases.agg(
        *[F.sum(c).alias(c) for c in ("produced", "consumed", "missing", "remaining")],
        F.avg(((F.col("missing") == 0) & (F.col("remaining") == 0)).cast("double")).alias("fit_cases"),
    )
    return sums.withColumn("fitness", _fitness(F.col("produced"), F.col("consumed"), F.col("missing"), F.col("remaining")))
