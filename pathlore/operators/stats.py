"""Tests and measures over groups.

All of them reduce to moments or to counts per distinct value, so the shuffled rows are
aggregates. Rank tests read running counts over the distinct values (``value_ranks``), which
stay parallel for any group size. p-values are two-sided and asymptotic.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.cdf import normal_quantile, p_chi2, p_f, p_ks, p_normal, p_t, polynomial
from pathlore.functions.ordered import DEFAULT, SkewPolicy, blocked_pairs, blocked_product, met_pairs, pair_blocks, quantiles, tiled_pairs, value_ranks, with_position



_NOTHING = 1e-28  # squared relative spread that is rounding of a constant


def _count() -> Column:
    return F.count(F.lit(1))


def pearson_p(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """r, n and p per group."""
    found = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.corr(x, y).alias("r"), _count().alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    p = F.when(F.abs("r") >= 1, 0.0).otherwise(p_t(t, F.col("n") - 2))
    return found.withColumn("p_value", F.when(F.col("r").isNotNull() & ~F.isnan("r"), p))


def corr_with_target(features: DataFrame, target: DataFrame, on: str = "user_id") -> DataFrame:
    """Correlation of each feature with a target, zeros counted, sorted by feature correlation.

    Absent cells of the long matrix are zeros: sums run over present cells, n over all users.
    All sums are of deviations from the means, so large values lose no digits.
    """
    y = target.select(on, F.col("target").cast("double").alias("y"))
    users = features.select(on).distinct().join(y, on)
    whole = users.agg(_count().alias("n"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"))
    n, my, vy = (whole.select(c).scalar() for c in ("n", "my", "vy"))
    cells = features.join(y, on).select("feature", F.col("value").cast("double").alias("x"), (F.col("y") - my).alias("dy"))
    means = cells.groupBy("feature").agg((F.sum("x") / n).alias("mx"), _count().alias("c"))
    dx = F.col("x") - F.col("mx")
    part = cells.join(means, "feature").groupBy("feature", "mx", "c").agg(
        F.sum(dx * dx).alias("sxx"), F.sum(dx * F.col("dy")).alias("sxy"), F.sum("dy").alias("sy")
    )
    # deviations of y add up to zero, so those of the absent cells are minus those of the present ones
    cov = F.col("sxy") + F.col("mx") * F.col("sy")
    sxx = F.col("sxx") + (n - F.col("c")) * F.col("mx") * F.col("mx")
    r = F.when((sxx > _NOTHING * n * F.col("mx") * F.col("mx")) & (vy > _NOTHING * my * my), cov / F.sqrt(sxx * vy * n))
    return part.select("feature", r.alias("r")).orderBy("r", "feature")


def corr_matrix(
    matrix: DataFrame,
    variable: str,
    observation: str,
    value: str = "value",
    block: int = 1024,
    slice_cells: int = 2_000_000,
) -> DataFrame:
    """All-pairs Pearson of ``variable`` over ``observation``: rows (u, v, rho) with u < v.

    Cells absent from the long form are zeros. Variables are hashed to blocks of about ``block``, so
    each task multiplies two matrices of bounded size whatever the shape of the input. While the
    observations of two blocks fit ``slice_cells`` a variable travels as one row and a task gives
    finished correlations: nothing of the size of the result is shuffled, joined or collected. Many
    variables then go to larger blocks, whose pairs are dealt with by ``block`` rows of either side.
    Else observations are hashed to slices (of a quarter of the cells where one block holds all
    variables); a task gives, for pairs that it has seen together, the sums over the observations
    that both hold, and what the other observations add follows from the means. Means are
    subtracted before the product, so large values lose no digits.
    """
    sizes = matrix.agg(F.count_distinct(variable).alias("p"), F.count_distinct(observation).alias("n")).first()
    n, blocks = sizes["n"], max(1, -(-sizes["p"] // block))
    room = slice_cells if blocks > 1 else max(1, slice_cells // 4)
    slices = max(1, -(-n * min(2 * block, sizes["p"]) // room))
    cells = matrix.where(F.col(value).isNotNull()).groupBy(variable, observation).agg(F.sum(value).cast("double").alias("x"))
    cells = cells.select(F.col(variable).alias("v"), F.xxhash64(observation).alias("o"), "x")
    return _corr_whole(cells, n, pair_blocks(sizes["p"], block, n, slice_cells), block) if slices == 1 else _corr_sliced(cells, n, blocks, slices)


def _varied(ss, mean, n):
    """Whether squared deviations are more than the rounding of a constant."""
    return ss > _NOTHING * n * mean * mean


def _corr_whole(cells: DataFrame, n: int, blocks: int, tile: int) -> DataFrame:
    """Correlations of variables whose cells (v, o, x) fit a row each."""
    import numpy as np
    import pyarrow as pa

    rows = cells.groupBy("v").agg(F.collect_list("o").alias("o"), F.collect_list("x").alias("x"))
    kind = dict(rows.dtypes)["v"]

    def deviations(table: pa.Table) -> tuple:
        lists = table.column("x").combine_chunks()
        x, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        seen, col = np.unique(table.column("o").combine_chunks().flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(size)), size)
        mean = np.bincount(row, x, len(size)) / n
        d = np.repeat(-mean[:, None], len(seen), axis=1)
        d[row, col] += x
        rest = n - len(seen)  # observations that no variable here holds
        ss = (d * d).sum(axis=1) + rest * mean * mean
        return table.column("v"), mean, d, rest, ss, ~_varied(ss, mean, n)

    def correlate(state: tuple, left: np.ndarray, right: np.ndarray) -> pa.Table:
        names, mean, d, rest, ss, flat = state
        cov = d[left] @ d[right].T + rest * np.outer(mean[left], mean[right])
        with np.errstate(divide="ignore", invalid="ignore"):
            rho = np.clip(cov / np.outer(np.sqrt(ss[left]), np.sqrt(ss[right])), -1.0, 1.0)
        void = flat[left][:, None] | flat[right][None, :]
        a, b, at = met_pairs(left, right)
        return pa.table({"u": names.take(pa.array(a)), "v": names.take(pa.array(b)), "rho": pa.array(rho[at], mask=void[at])})

    return tiled_pairs(rows, "v", blocks, tile, deviations, correlate, f"u {kind}, v {kind}, rho double")


def _corr_sliced(cells: DataFrame, n: int, blocks: int, slices: int) -> DataFrame:
    """Correlations from sums over slices of the observations."""
    import numpy as np
    import pandas as pd

    kind = dict(cells.dtypes)["v"]
    means = cells.groupBy("v").agg((F.sum("x") / n).alias("m"), _count().alias("_c"))
    cells = cells.join(means.select("v", "m"), "v").select("v", "o", "m", (F.col("x") - F.col("m")).alias("d"))
    squares = cells.groupBy("v").agg(F.sum(F.col("d") * F.col("d")).alias("_dd"))
    sums = means.join(squares, "v").select("v", "m", (F.col("_dd") + (n - F.col("_c")) * F.col("m") * F.col("m")).alias("ss"))

    def owned(names, home, key):
        i, j = np.triu_indices(len(names), 1)
        mine = (np.minimum(home[i], home[j]) == key[0]) & (np.maximum(home[i], home[j]) == key[1])
        return i[mine], j[mine]

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(pdf["v"].to_numpy(), return_inverse=True)
        seen, col = np.unique(pdf["o"].to_numpy(), return_inverse=True)
        mean, home = np.empty(len(names)), np.empty(len(names), dtype=np.int64)
        mean[row], home[row] = pdf["m"].to_numpy(), pdf["_block"].to_numpy()
        d, held = np.zeros((len(names), len(seen))), np.zeros((len(names), len(seen)))
        d[row, col], held[row, col] = pdf["d"].to_numpy(), 1.0
        both, one = held @ held.T, d @ held.T  # observations of both; deviations of the first there
        sxy = d @ d.T + one * mean[None, :] + one.T * mean[:, None]
        i, j = owned(names, home, key)
        met = both[i, j] > 0
        i, j = i[met], j[met]
        return pd.DataFrame({"u": names[i], "v": names[j], "sxy": sxy[i, j], "both": both[i, j]})

    def pair_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)
        i, j = owned(pdf["v"].to_numpy(), pdf["_block"].to_numpy(), key)
        cols = {"u": pdf["v"].to_numpy()[i], "v": pdf["v"].to_numpy()[j]}
        for c in ("m", "ss"):
            cols |= {f"{c}1": pdf[c].to_numpy()[i], f"{c}2": pdf[c].to_numpy()[j]}
        return pd.DataFrame(cols)

    sliced = blocked_pairs(cells, "v", blocks).withColumn("_slice", F.pmod(F.col("o"), F.lit(slices)))
    products = sliced.groupBy("_bi", "_bj", "_slice").applyInPandas(multiply, f"u {kind}, v {kind}, sxy double, both double")
    pairs = blocked_pairs(sums, "v", blocks).groupBy("_bi", "_bj").applyInPandas(
        pair_up, f"u {kind}, v {kind}, m1 double, m2 double, ss1 double, ss2 double"
    )
    # one sum over both, as either side of a join would be taken for a small table
    ends = ("m1", "m2", "ss1", "ss2")
    pairs = pairs.unionByName(products, allowMissingColumns=True).groupBy("u", "v").agg(
        F.sum("sxy").alias("sxy"), F.sum("both").alias("both"), *[F.max(c).alias(c) for c in ends]
    )
    # sum over both of (d1 + m1)(d2 + m2), less n * m1 * m2
    cov = F.coalesce("sxy", F.lit(0.0)) + (F.coalesce("both", F.lit(0.0)) - n) * F.col("m1") * F.col("m2")
    varied = [_varied(F.col(f"ss{k}"), F.col(f"m{k}"), n) for k in (1, 2)]
    r = cov / (F.sqrt("ss1") * F.sqrt("ss2"))
    rho = F.when(varied[0] & varied[1], F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pairs.select("u", "v", rho.alias("rho"))


def moments(df: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(
        _count().alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def _two_sides(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...]) -> DataFrame:
    aggs = []
    for i, g in enumerate(pair, 1):
        x = F.when(F.col(group) == g, F.col(value))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.var_samp(x).alias(f"_v{i}")]
    return df.groupBy(*by).agg(*aggs)


def ttest_student(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    """Pooled-variance t of the two groups in ``pair``."""
    m = _two_sides(df, group, value, pair, by)
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2")) / dof
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    m = m.withColumns({"statistic": t, "df1": dof.cast("double")})
    return m.withColumn("p_value", p_t(F.col("statistic"), F.col("df1"))).drop("_v1", "_v2")


def ttest_welch(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...] = ()) -> DataFrame:
    m = _two_sides(df, group, value, pair, by)
    a, b = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)
    dof = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    m = m.withColumns({"statistic": t, "df1": dof})
    return m.withColumn("p_value", p_t(F.col("statistic"), F.col("df1"))).drop("_v1", "_v2")


def _pair_ranks(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...], policy: SkewPolicy) -> DataFrame:
    both = df.where(F.col(group).isin(*pair))
    counts = {f"c{i}": F.count_if(F.col(group) == g) for i, g in enumerate(pair, 1)}
    return value_ranks(both, list(by), value, counts, policy)


def mann_whitney(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """U of the first group with tie-corrected, continuity-corrected normal p."""
    r = _pair_ranks(df, group, value, pair, by, policy)
    ties = F.col("c1") + F.col("c2")
    upto = F.col("cum_c1") + F.col("cum_c2")
    mean_rank = upto - (ties - 1) / 2
    s = r.groupBy(*by).agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.sum(F.col("c1") * mean_rank).alias("_r1"),
        F.sum(ties.cast("double") * ties * ties - ties).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = (F.abs(F.col("statistic") - n1 * n2 / 2) - 0.5) / sd
    s = s.withColumn("statistic", u)
    p = F.least(F.lit(1.0), F.when(z < 0, 1.0).otherwise(p_normal(z)))
    return s.withColumn("p_value", F.when(sd > 0, p)).drop("_r1", "_ties")


def ks_two_sample(df: DataFrame, group: str, value: str, pair: tuple, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Largest gap between the two empirical distribution functions."""
    r = _pair_ranks(df, group, value, pair, by, policy)
    sizes = r.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    if by:
        r = r.join(sizes, list(by))
    else:
        r = r.withColumns({c: sizes.select(c).scalar() for c in ("n1", "n2")})
    gap = F.abs(F.col("cum_c1") / F.col("n1") - F.col("cum_c2") / F.col("n2"))
    s = r.groupBy(*by).agg(F.max(gap).alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return s.withColumn("p_value", p_ks(F.col("statistic"), F.col("n1"), F.col("n2")))


def anova_oneway(df: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One-way F; the spread between groups is taken around a group's mean, so large values lose no digits."""
    g = moments(df, group, value, by)
    about = g.groupBy(*by).agg(F.min("mean").alias("_about"))
    if by:
        g = g.join(about, list(by))
    else:
        g = g.withColumn("_about", about.scalar())
    off = F.col("mean") - F.col("_about")
    s = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * off).alias("_s"),
        F.sum(F.col("n") * off * off).alias("_ss"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("_within"),
    )
    df1, df2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    between = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")
    f = F.try_divide(between / df1, F.col("_within") / df2)
    s = s.select(*by, f.alias("statistic"), df1.cast("double").alias("df1"), df2.cast("double").alias("df2"))
    return s.withColumn("p_value", p_f(F.col("statistic"), F.col("df1"), F.col("df2")))


def levene(df: DataFrame, group: str, value: str, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """One-way F on absolute deviations from group medians."""
    keys = [*by, group]
    medians = quantiles(df, keys, value, {"_median": 0.5}, policy)
    dev = df.join(medians, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    return anova_oneway(dev, group, "_dev", by)


def group_ranks(df: DataFrame, group: str, value: str, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """One row per (value, group): count, average rank of the value among all groups, tie size."""
    ranks = value_ranks(df, list(by), value, {"ties": _count()}, policy)
    ranks = ranks.withColumn("rank", F.col("cum_ties") - (F.col("ties") - 1) / 2).drop("cum_ties")
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value, group).agg(_count().alias("c"))
    return cells.join(ranks, [*by, value])


def _rank_sums(df: DataFrame, group: str, value: str, by: tuple[str, ...], policy: SkewPolicy) -> DataFrame:
    r = group_ranks(df, group, value, by, policy)
    t = F.col("ties").cast("double")
    # each tied block is met once per group, so its tie term is shared out by count
    return r.groupBy(*by, group).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("rank")).alias("r"),
        F.sum(F.col("c") * F.col("rank") * F.col("rank")).alias("rr"),
        F.sum(F.col("c") * (t * t - 1)).alias("tie"),
    )


def kruskal(df: DataFrame, group: str, value: str, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    g = _rank_sums(df, group, value, by, policy)
    s = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q"), F.sum("tie").alias("_t")
    )
    n = F.col("_n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    s = s.select(*by, h.alias("statistic"), (F.col("_k") - 1).cast("double").alias("df1"))
    return s.withColumn("p_value", p_chi2(F.col("statistic"), F.col("df1")))


def conover_posthoc(df: DataFrame, group: str, value: str, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Pairwise rank comparison of groups after Kruskal-Wallis, t with n - k degrees of freedom."""
    g = _rank_sums(df, group, value, by, policy)
    s = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.sum("rr").alias("_rr"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q"), F.sum("tie").alias("_t"),
    )
    n, k = F.col("_n").cast("double"), F.col("_k")
    s2 = (F.col("_rr") - n * (n + 1) * (n + 1) / 4) / (n - 1)
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    s = s.select(*by, (n - k).alias("df1"), (s2 * (n - 1 - h) / (n - k)).alias("_b"))
    mean = F.col("r") / F.col("n")
    left = g.select(*by, F.col(group).alias("group1"), mean.alias("_m1"), F.col("n").alias("n1"))
    right = g.select(*by, F.col(group).alias("group2"), mean.alias("_m2"), F.col("n").alias("n2"))
    # one row per group on either side; the result itself is one row per pair of groups
    if by:
        pairs = left.join(right, list(by)).where("group1 < group2").join(s, list(by))
    else:
        pairs = blocked_product(left, right).where("group1 < group2")
        pairs = pairs.withColumns({c: s.select(c).scalar() for c in ("df1", "_b")})
    t = (F.col("_m1") - F.col("_m2")) / F.sqrt(F.col("_b") * (1 / F.col("n1") + 1 / F.col("n2")))
    pairs = pairs.select(*by, "group1", "group2", "n1", "n2", t.alias("statistic"), "df1")
    return pairs.withColumn("p_value", p_t(F.col("statistic"), F.col("df1")))


def normaltest(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """D'Agostino-Pearson K2 from population skewness and kurtosis."""
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        _count().alias("n"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2")
    )
    n = F.col("n").cast("double")
    y = F.col("_g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    a = F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(y / a) / F.sqrt(F.log(F.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("_g2") + 3 - mean) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    c = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    z2 = ((1 - 2 / (9 * c)) - F.cbrt((1 - 2 / c) / (1 + x * F.sqrt(2 / (c - 4))))) / F.sqrt(2 / (9 * c))
    m = m.select(*by, "n", z1.alias("z_skew"), z2.alias("z_kurtosis"), (z1 * z1 + z2 * z2).alias("statistic"))
    return m.withColumn("p_value", p_chi2(F.col("statistic"), F.lit(2)))


# Fixed values of the Shapiro-Wilk weights and of the normal approximation of its statistic,
# highest power first.
SW_LAST = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0)
SW_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SW_SMALL = {"gamma": (0.459, -2.273), "mean": (-0.0006714, 0.025054, -0.39978, 0.5440), "log_sd": (-0.0020322, 0.062767, -0.77857, 1.3822)}
SW_LARGE = {"mean": (0.0038915, -0.083751, -0.31082, -1.5861), "log_sd": (0.0030302, -0.082676, -0.4803)}


def shapiro_wilk(df: DataFrame, value: str, by: tuple[str, ...] = (), policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Shapiro-Wilk W per group: how well the ordered values follow normal order statistics.

    Weights come from the expected order statistics at the exact ranks, corrected at two values on
    either end (one up to five values). ``p_value`` uses the normal approximation that was
    fitted up to 5,000 values. Null values are left out; fewer than three values or equal
    ones give null. Ranks are counted by range, so a group of any size is spread.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    rest = rows.groupBy(*by).agg(_count().alias("n"), F.avg("_x").alias("_mean"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    placed = with_position(rows, list(by), ["_x"], "_pos", policy)
    if by:
        placed = placed.join(rest, list(by))
    else:
        placed = placed.withColumns({c: rest.select(c).scalar() for c in ("n", "_mean", "_lo", "_hi")})
    share = (F.col("_pos") - 0.375) / (F.col("n") + 0.25)
    placed = placed.withColumn("_d", F.col("_x") - F.col("_mean")).withColumn("_m", normal_quantile(share))
    at = lambda k, c: F.max(F.when(F.col("_pos") == k, F.col(c)))
    n = F.col("n")
    sums = placed.groupBy(*by, "n", "_lo", "_hi").agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.sum(F.col("_m") * F.col("_d")).alias("_md"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        at(n, "_m").alias("_m1"), at(n - 1, "_m").alias("_m2"), (at(n, "_d") - at(F.lit(1), "_d")).alias("_r1"), (at(n - 1, "_d") - at(F.lit(2), "_d")).alias("_r2"),
    )
    mm, m1, m2, r1, r2 = (F.col(c) for c in ("_mm", "_m1", "_m2", "_r1", "_r2"))
    u = 1 / F.sqrt(n.cast("double"))
    last = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(m1 / F.sqrt(mm) + polynomial(u, SW_LAST))
    second = m2 / F.sqrt(mm) + polynomial(u, SW_SECOND)
    one = F.sqrt((mm - 2 * m1 * m1) / (1 - 2 * last * last))
    two = F.sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last * last - 2 * second * second))
    inner = F.col("_md") - m1 * r1
    sum_one = last * r1 + F.when(n == 3, 0.0).otherwise(inner / one)
    sum_two = last * r1 + second * r2 + (inner - m2 * r2) / two
    total = F.when(n <= 5, sum_one).otherwise(sum_two)
    w = F.when((n >= 3) & (F.col("_lo") < F.col("_hi")), F.least(F.lit(1.0), total * total / F.col("_ss")))
    out = sums.select(*by, "n", w.alias("statistic"))
    x, left = n.cast("double"), F.log(1 - F.col("statistic"))
    small = (-F.log(polynomial(x, SW_SMALL["gamma"]) - left) - polynomial(x, SW_SMALL["mean"])) / F.exp(polynomial(x, SW_SMALL["log_sd"]))
    large = (left - polynomial(F.log(x), SW_LARGE["mean"])) / F.exp(polynomial(F.log(x), SW_LARGE["log_sd"]))
    z = F.when(n <= 11, small).otherwise(large)
    half = p_normal(F.col("_z")) / 2
    three = F.greatest(F.lit(0.0), 6 / F.lit(math.pi) * (F.asin(F.sqrt("statistic")) - F.asin(F.sqrt(F.lit(0.75)))))
    p = F.when(n == 3, three).when(F.col("statistic") == 1, 1.0).otherwise(F.when(F.col("_z") > 0, half).otherwise(1 - half))
    out = out.withColumn("_z", F.when(n > 3, z))
    return out.select(*by, "n", "statistic", F.when(F.col("statistic").isNotNull(), p).alias("p_value"))


def _margins(df: DataFrame, a: str, b: str, weight: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.sum(weight).cast("long") if weight else _count()
    seen = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))
    return seen, seen.groupBy("a").agg(F.sum("n").alias("_r")), seen.groupBy("b").agg(F.sum("n").alias("_c"))


def chi2_contingency(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Chi-square of independence; 2 x 2 tables get the Yates correction.

    Empty cells are not built: each adds its expected count, and all expected counts sum to n.
    """
    seen, rows, cols = _margins(df, a, b, weight)
    total = seen.agg(F.sum("n")).scalar()
    r = rows.agg(_count().alias("k"), F.sum(1 / F.col("_r")).alias("inv"))
    c = cols.agg(_count().alias("k"), F.sum(1 / F.col("_c")).alias("inv"))
    expected = F.col("_r") * F.col("_c") / total
    gap = F.abs(F.col("n") - expected)
    s = seen.join(rows, "a").join(cols, "b").agg(
        (F.sum(gap * gap / expected) + total - F.sum(expected)).alias("_plain"), F.max(gap).alias("_gap")
    )
    dof = (r.select("k").scalar() - 1) * (c.select("k").scalar() - 1)
    # in a 2 x 2 table all four cells are off by the same amount
    off = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    yates = off * off * total * r.select("inv").scalar() * c.select("inv").scalar()
    s = s.select(F.when(dof == 1, yates).otherwise(F.col("_plain")).alias("statistic"), dof.cast("double").alias("df1"))
    return s.withColumn("p_value", p_chi2(F.col("statistic"), F.col("df1")))


def contingency(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """All cells (a, b, n, expected), empty ones included."""
    seen, rows, cols = _margins(df, a, b, weight)
    total = seen.agg(F.sum("n")).scalar()
    full = blocked_product(rows, cols).join(seen, ["a", "b"], "left")
    return full.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.col("_r") * F.col("_c") / total).alias("expected"))


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b from the grid of cell counts; row pairs are never built.

    Cumulating the grid over y and then over x gives, for each cell, the rows below it in both.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(_count().alias("n"))
    tx, ty = (cells.groupBy(c).agg(F.sum("n").alias("n")) for c in ("x", "y"))
    grid = blocked_product(tx.select("x"), ty.select("y")).join(cells, ["x", "y"], "left").na.fill(0, ["n"])
    column = Window.partitionBy("x").orderBy("y")
    grid = grid.select("x", "y", "n", F.sum("n").over(column).alias("_upto"), F.sum("n").over(Window.partitionBy("x")).alias("_all"))
    row = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(
        "n", F.sum(F.col("_upto") - F.col("n")).over(row).alias("_below"), F.sum(F.col("_all") - F.col("_upto")).over(row).alias("_above")
    )
    s = grid.agg(F.sum(F.col("n") * (F.coalesce("_below", F.lit(0)) - F.coalesce("_above", F.lit(0))))).scalar()
    half = F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)
    size = cells.agg(F.sum("n").alias("n"))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    tied = [t.agg(half).scalar() for t in (tx, ty)]
    return size.select("n", (s / F.sqrt((n0 - tied[0]) * (n0 - tied[1]))).alias("tau"))


def kurtosis(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.kurtosis(value).alias("kurtosis"))


def compare_means(df: DataFrame, group: str, pair: tuple, feature: str = "feature", value: str = "value", policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Per feature: means and sds of both groups with the rank test; names ``type_week`` are split
    at the last underscore."""
    aggs = []
    for i, g in enumerate(pair, 1):
        x = F.when(F.col(group) == g, F.col(value))
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    m = df.groupBy(feature).agg(*aggs)
    u = mann_whitney(df, group, value, pair, (feature,), policy)
    name, split = F.col(feature).cast("string"), "(?s)^(.*)_([^_]*)$"
    found = name.rlike(split)
    return m.join(u, feature).withColumns(
        {
            "material_type": F.when(found, F.regexp_extract(name, split, 1)).otherwise(name),
            "of_week": F.when(found, F.regexp_extract(name, split, 2)),
        }
    )


def community_scores(members: DataFrame, scores: DataFrame, test_groups: int = 8, policy: SkewPolicy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Per (level, community): size, mean, sd; and the three group tests of levels with ``test_groups`` groups."""
    joined = members.join(scores, "node")
    sizes = joined.groupBy("level", "community").agg(
        _count().alias("size"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd")
    )
    levels = sizes.groupBy("level").agg(_count().alias("_g")).where(F.col("_g") == test_groups)
    chosen = joined.join(levels.select("level"), "level", "left_semi")
    tests = [
        fn(chosen, "community", "score", ("level",)).select("level", F.lit(name).alias("test"), "statistic", "p_value")
        for name, fn in (("anova", anova_oneway), ("levene", levene), ("kruskal", kruskal))
    ]
    return sizes, reduce(DataFrame.unionByName, tests)


def bartlett_kmo(matrix: DataFrame, variable: str, observation: str, value: str = "value", max_features: int = 4000) -> DataFrame:
    """Bartlett's sphericity chi-square and the overall Kaiser-Meyer-Olkin measure.

    The correlation matrix is aggregated on Spark; only its p x p entries, p checked, are solved
    on the driver.
    """
    import numpy as np

    from pathlore.operators.spectral import symmetric

    n = matrix.select(observation).distinct().count()
    rho = corr_matrix(matrix, variable, observation, value)
    names, r = symmetric(rho, "u", "v", "rho", diagonal=1.0, limit=max_features)
    p = len(names)
    # constant features have no correlation; a singular matrix (fewer rows than features, repeated
    # features) has no determinant to test, and its partial correlations come from the pseudo-inverse
    fixed = ~np.isfinite(r).all(axis=1) if p else np.empty(0, bool)
    r = np.where(np.isfinite(r), r, 0.0)
    singular = bool(fixed.any()) or np.linalg.matrix_rank(r) < p
    chi2 = None if singular else float(-(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1])
    inv = np.linalg.pinv(r, hermitian=True) if singular else np.linalg.inv(r)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(p, dtype=bool)
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    spark = matrix.sparkSession
    out = spark.createDataFrame([(chi2, p * (p - 1) / 2, float(kmo))], "statistic double, df1 double, kmo double")
    return out.withColumn("p_value", p_chi2(F.col("statistic"), F.col("df1")))
