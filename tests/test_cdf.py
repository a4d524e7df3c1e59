from __future__ import annotations

import math

import numpy as np
import pytest

from pathlore.functions.cdf import kolmogorov_sf, lower_beta, p_chi2, p_f, p_normal, p_t, upper_gamma


def test_closed_forms():
    x = np.array([0.01, 0.5, 1.0, 3.0, 20.0, 80.0])
    assert upper_gamma(1.0, x) == pytest.approx(np.exp(-x))
    assert upper_gamma(2.0, x) == pytest.approx((1 + x) * np.exp(-x))
    assert upper_gamma(0.5, x) == pytest.approx([math.erfc(math.sqrt(v)) for v in x])
    u = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    assert lower_beta(1.0, 1.0, u) == pytest.approx(u)
    assert lower_beta(3.0, 1.0, u) == pytest.approx(u**3)
    assert lower_beta(1.0, 4.0, u) == pytest.approx(1 - (1 - u) ** 4)
    assert lower_beta(2.0, 3.0, u) == pytest.approx(6 * u**2 - 8 * u**3 + 3 * u**4)


def _integral(log_density, lo, hi, n=400_001):
    x = np.linspace(lo, hi, n)
    y = np.exp(log_density(x))
    return (y.sum() - (y[0] + y[-1]) / 2) * (x[1] - x[0])


@pytest.mark.parametrize("df", [10.0, 1e5, 1e8])
@pytest.mark.parametrize("z", [-3.0, -0.5, 0.0, 1.0, 4.0])
def test_tails_against_quadrature(df, z):
    a = df / 2
    x = a + z * math.sqrt(a)
    # Gamma(a): the density around its mode, on a scale where nothing cancels
    log_gamma = lambda v: (a - 1) * np.log1p((v - a) / a) - (v - a)
    lo, hi = max(1e-9, a - 14 * math.sqrt(a)), a + 60 + 14 * math.sqrt(a)
    if x > 0:
        whole = _integral(log_gamma, lo, hi)
        assert upper_gamma(a, np.array([x]))[0] == pytest.approx(_integral(log_gamma, max(x, lo), hi) / whole, abs=1e-8)
    # Beta(a, b) with b near a
    b = 0.8 * a
    x0, s = a / (a + b), math.sqrt(a * b / (a + b) ** 3)
    y = x0 + z * s
    log_beta = lambda v: (a - 1) * np.log1p((v - x0) / x0) + (b - 1) * np.log1p(-(v - x0) / (1 - x0))
    lo, hi = max(1e-9, x0 - 14 * s), min(1 - 1e-9, x0 + 14 * s)
    if 0 < y < 1:
        part = _integral(log_beta, lo, max(y, lo)) / _integral(log_beta, lo, hi)
        assert lower_beta(a, b, np.array([y]))[0] == pytest.approx(part, abs=1e-8)


def test_large_degrees():
    # t with many degrees of freedom is normal, F(d, infinity) is chi-square
    for df in (1e6, 1e8, 1e12, 1e14):
        t = 0.5
        assert lower_beta(df / 2, 0.5, np.array([df / (df + t * t)]), t * t / (df + t * t))[0] == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-6)
    assert lower_beta(5e7, 5e7, np.array([0.5]))[0] == pytest.approx(0.5, abs=1e-12)
    assert upper_gamma(5e7, np.array([5e7]))[0] == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * 5e7)), abs=1e-10)
    assert lower_beta(1e-3, 5.0, np.array([1e-12]))[0] > 0.9


def test_columns(spark):
    df = spark.createDataFrame([(2.0, 10.0, 2.0), (0.0, 3.0, 4.0), (None, 3.0, 4.0)], "s double, a double, b double")
    rows = df.select(p_t(df.s, df.a), p_f(df.s, df.b, df.a), p_chi2(df.s, df.b), p_normal(df.s)).collect()
    assert list(rows[0]) == pytest.approx([0.0733880, (1 + 2 * 2 / 10) ** -5, math.exp(-1), 0.0455003], abs=1e-6)
    assert list(rows[1]) == pytest.approx([1.0, 1.0, 1.0, 1.0])
    assert list(rows[2]) == [None] * 4


def test_kolmogorov():
    assert kolmogorov_sf(np.array([0.0, 1.3581, 1.6276])) == pytest.approx([1.0, 0.05, 0.01], abs=1e-4)
