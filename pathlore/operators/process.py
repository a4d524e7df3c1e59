"""Directly-follows graphs of cohorts and how logs fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.functions.ordered import DEFAULT, SkewPolicy, with_next
from pathlore.operators.log import pairs_all
from pathlore.operators.matrix import EDGE, ORDER, steps


def dfg(log: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    return steps(log, policy).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def dfg_complete(graph: DataFrame, activities: DataFrame, col: str = "activity") -> DataFrame:
    """Every ordered pair of ``activities``, 0 where the graph has no edge."""
    return pairs_all(activities, col).join(graph, ["src", "dst"], "left").na.fill(0, ["n"])


def dfg_percentage(graph: DataFrame) -> DataFrame:
    """Share of the outgoing steps; null for an activity without any."""
    totals = graph.groupBy("src").agg(F.sum("n").alias("_total"))
    return graph.join(totals, "src").withColumn("share", F.try_divide("n", "_total")).drop("_total")


def dfg_per_person(graph: DataFrame, log: DataFrame) -> DataFrame:
    people = log.agg(F.count_distinct("user_id")).scalar()
    return graph.withColumn("per_person", F.try_divide(F.col("n"), people))


def dfg_diff(a: DataFrame, b: DataFrame, value: str = "n") -> DataFrame:
    left, right = (d.select("src", "dst", F.col(value).alias(x)) for d, x in ((a, "_a"), (b, "_b")))
    zero = F.lit(0)
    return left.join(right, ["src", "dst"], "full").select(
        "src", "dst", (F.coalesce("_a", zero) - F.coalesce("_b", zero)).alias("diff")
    )


def dependency_graph(graph: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges with their dependency (ab - ba) / (ab + ba + 1), self loops aa / (aa + 1)."""
    back = graph.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("_ba"))
    both = graph.join(back, ["src", "dst"], "left").na.fill(0, ["_ba"])
    dep = F.when(F.col("src") == F.col("dst"), F.col("n") / (F.col("n") + 1)).otherwise(
        (F.col("n") - F.col("_ba")) / (F.col("n") + F.col("_ba") + 1)
    )
    return both.select("src", "dst", "n", dep.alias("dependency")).where(F.col("dependency") >= threshold)


def _moves_of_cases(log: DataFrame, model: DataFrame, policy: SkewPolicy) -> DataFrame:
    """Steps per (case, src, dst), null dst for the end of a case, and whether the model has them.

    Counted before the join, in the partitioning by case that finding the steps has made.
    """
    nexts = with_next(log, ["case_id"], ORDER, {"dst": "activity"}, policy)
    moves = nexts.groupBy("case_id", F.col("activity").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = model.select("src", "dst", F.lit(1).alias("_in")).distinct()
    return moves.join(edges, ["src", "dst"], "left")


def _fitness(moves: DataFrame) -> DataFrame:
    n = F.when(F.col("dst").isNotNull(), F.col("n")).otherwise(0)
    per_case = moves.groupBy("case_id").agg(
        F.sum(n).alias("steps"), F.sum(F.when(F.col("_in").isNotNull(), n).otherwise(0)).alias("ok")
    )
    return per_case.agg(
        F.try_divide(F.sum("ok"), F.sum("steps")).alias("fit_steps"),
        F.avg((F.col("ok") == F.col("steps")).cast("double")).alias("fit_cases"),
    )


def dfg_fitness(log: DataFrame, model: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Share of steps the model allows and share of cases whose steps are all allowed."""
    return _fitness(_moves_of_cases(log, model, policy))


def dfg_precision(log: DataFrame, model: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Model edges seen in the log / model edges that start at an activity the log reaches."""
    edges = model.select("src", "dst").distinct()
    seen = dfg(log, policy).select("src", "dst", F.lit(1).alias("_seen"))
    reached = log.select(F.col("activity").alias("src")).distinct()
    open_edges = edges.join(reached, "src", "left_semi").join(seen, ["src", "dst"], "left")
    return open_edges.agg(
        F.count("_seen").alias("seen_edges"),
        F.count(F.lit(1)).alias("open_edges"),
        F.try_divide(F.count("_seen"), F.count(F.lit(1))).alias("precision"),
    )


def model_size(model: DataFrame) -> DataFrame:
    edges = model.select("src", "dst").distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count(F.lit(1))).scalar()
    return edges.agg(nodes.alias("nodes"), F.count(F.lit(1)).alias("edges")).withColumn(
        "density", F.try_divide(F.col("edges"), F.col("nodes") * F.col("nodes"))
    )


def student_vs_models(log: DataFrame, model1: DataFrame, model2: DataFrame, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Each user's step fitness against two models."""
    nexts = with_next(log, ["case_id"], ORDER, {"dst": "activity"}, policy)
    moves = nexts.where(F.col("dst").isNotNull()).groupBy("user_id", F.col("activity").alias("src"), "dst").agg(
        F.count(F.lit(1)).alias("n")
    )
    for i, model in ((1, model1), (2, model2)):
        moves = moves.join(model.select("src", "dst", F.lit(1).alias(f"_in{i}")).distinct(), ["src", "dst"], "left")
    fits = [
        (F.sum(F.when(F.col(f"_in{i}").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias(f"fit{i}") for i in (1, 2)
    ]
    return moves.groupBy("user_id").agg(*fits)


def edges_from_contribution(contribution: DataFrame, k: int, feature: str = "feature", sep: str = EDGE) -> DataFrame:
    """Edges of the k transitions that contribute most; ``sep`` stands between their activities.

    Activity names hold hyphens, so features are to be joined by a character that no name has.
    """
    top = contribution.orderBy(F.desc("contribution"), feature).limit(k)
    at = F.instr(F.col(feature), sep)
    src, dst = F.substring(F.col(feature), F.lit(1), at - 1), F.substring(F.col(feature), at + len(sep), F.length(feature))
    return top.select(F.when(at > 0, src).alias("src"), F.when(at > 0, dst).alias("dst"), "contribution")
