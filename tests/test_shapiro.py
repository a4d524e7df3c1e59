from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from pathlore.functions.cdf import normal_quantile
from pathlore.functions.ordered import SkewPolicy
from pathlore.operators import stats as T

WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def statistic(values):
    xs, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    ends = 2 if n > 5 else 1
    a = [0.0] * n
    a[-1] = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a[-2] = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    if n == 3:
        a = [0.0, 0.0, math.sqrt(0.5)]
    for i in range(ends):
        a[i] = -a[-1 - i]
    if n > 3:
        scale = math.sqrt((mm - 2 * sum(v * v for v in m[-ends:])) / (1 - 2 * sum(v * v for v in a[-ends:])))
        a[ends:-ends] = [v / scale for v in m[ends:-ends]]
    mean = sum(xs) / n
    return sum(w * x for w, x in zip(a, xs)) ** 2 / sum((x - mean) ** 2 for x in xs)


def test_quantile(spark):
    ps = [1e-12, 1e-5, 0.01, 0.02425, 0.1, 0.5, 0.7, 0.98, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p"))).collect()
    assert all(z == pytest.approx(NormalDist().inv_cdf(p), rel=3e-9, abs=1e-12) for p, z in got)


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(3, 4)])
def test_groups(spark, policy):
    r = random.Random(7)
    groups = {"weights": WEIGHTS, "flat": [2.0] * 9, "two": [1, 5], "far": [1e6 + r.gauss(0, 1) for _ in range(80)]}
    groups |= {f"n{n}": [round(r.gauss(0, 3), 1) for _ in range(n)] for n in (3, 4, 5, 6, 12, 60)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("weights", None)]
    got = {g: (n, w, p) for g, n, w, p in T.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", ("g",), policy).collect()}
    assert set(got) == set(groups) and all(got[g][0] == len(xs) for g, xs in groups.items())
    assert got["flat"][1:] == (None, None) and got["two"][1:] == (None, None)
    for g, xs in groups.items():
        if g not in ("flat", "two"):
            assert got[g][1] == pytest.approx(statistic(xs), rel=1e-7) and 0 <= got[g][2] <= 1
    assert got["weights"][1] == pytest.approx(0.78881478, abs=1e-6) and got["weights"][2] == pytest.approx(0.00670381, abs=1e-6)


def test_without_groups(spark):
    df = spark.createDataFrame([(float(x),) for x in WEIGHTS], "x double")
    (row,) = T.shapiro_wilk(df, "x").collect()
    assert row.n == 11 and row.statistic == pytest.approx(statistic(WEIGHTS), rel=1e-7)
    assert T.shapiro_wilk(df.where("false"), "x").count() == 0
