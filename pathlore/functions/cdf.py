"""Two-sided p-values for small result tables, as Arrow-batched columns.

Spark SQL has no t, F, chi-square or normal distribution function. The two special functions
behind all of them are summed here over whole columns until they converge, and by
uniform asymptotic forms where a parameter is large.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LARGE = 1e5  # parameters from which the uniform asymptotic form is exact to 1e-9


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def _stirling(z: np.ndarray) -> np.ndarray:
    """log Gamma(z) minus (z - 1/2) log z - z + log(2 pi) / 2."""
    z = np.asarray(z, float)
    small = _log_gamma(z) - (z - 0.5) * np.log(z) + z - 0.5 * math.log(2 * math.pi)
    w = np.maximum(z, 10.0)
    return np.where(z < 10, small, 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7))


def _log1p_rest(u: np.ndarray) -> np.ndarray:
    """u - log(1 + u), also where u is small."""
    v = np.where(np.abs(u) < 0.02, u, 0.0)
    series = sum((-1) ** k * v**k / k for k in range(2, 12))
    with np.errstate(divide="ignore"):
        return np.where(np.abs(u) < 0.02, series, u - np.log1p(u))


def _continued(first: np.ndarray, terms) -> np.ndarray:
    """first + a1 / (b1 + a2 / (b2 + ...)) until it no longer changes; ``terms(k)`` gives (a_k, b_k)."""
    tiny = 1e-300
    value = np.where(first == 0, tiny, first)
    c, d = value.copy(), np.zeros_like(value)
    k = 0
    while True:
        k += 1
        a, b = terms(k)
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        step = c * d
        value = value * step
        if np.all(np.abs(step - 1) < 1e-15):
            return value


def _upper_gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion of Q(a, x) for large a, with its first correction."""
    u = (x - a) / a
    half = _log1p_rest(u)
    eta = np.sign(u) * np.sqrt(2 * half)
    near = np.abs(eta) < 0.05
    e = np.where(near, eta, 0.0)
    series = -1 / 3 + e / 12 - 2 * e**2 / 135 + e**3 / 864 + e**4 / 2835 - 139 * e**5 / 777600
    far = 1 / np.where(near, 1.0, u) - 1 / np.where(near, 1.0, eta)
    rest = np.exp(-a * half) / np.sqrt(2 * math.pi * a) * np.where(near, series, far)
    return 0.5 * _erfc(eta * np.sqrt(a / 2)) + rest


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = (v.copy() for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))
    out = np.full(a.shape, np.nan)
    out[x <= 0] = 1.0
    large = (x > 0) & (a > _LARGE)
    if large.any():
        out[large] = _upper_gamma_large(a[large], x[large])
    front = lambda p, y: np.sqrt(p / (2 * math.pi)) * np.exp(-p * _log1p_rest((y - p) / p) - _stirling(p))
    low = (x > 0) & (a <= _LARGE) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term, k = 1 / al, 0
        total = term.copy()
        while np.any(term > 1e-17 * total):
            k += 1
            term = term * xl / (al + k)
            total += term
        out[low] = 1.0 - total * front(al, xl)
    high = (x > 0) & (a <= _LARGE) & (x >= a + 1)
    if high.any():
        ah, xh = a[high], x[high]
        tail = _continued(xh + 1 - ah, lambda k: (-k * (k - ah), xh + 2 * k + 1 - ah))
        out[high] = front(ah, xh) / tail
    return np.clip(out, 0, 1)


def _lower_beta_large(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion of I_x(a, b) for large a and b, with its first correction."""
    r = a + b
    x0, y0 = a / r, b / r
    d = x - x0
    half = x0 * _log1p_rest(d / x0) + y0 * _log1p_rest(-d / y0)
    eta = np.sign(d) * np.sqrt(2 * half)
    s = np.sqrt(x0 * y0)
    close = np.abs(d) < 1e-8 * s
    rest = np.where(close, (1 - 2 * x0) / (3 * s), 1 / np.where(close, 1.0, eta) - s / np.where(close, 1.0, d))
    return 0.5 * _erfc(-eta * np.sqrt(r / 2)) + np.exp(-r * half) / np.sqrt(2 * math.pi * r) * rest


def lower_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); ``rest`` is 1 - x where that is known more exactly."""
    rest = 1 - np.asarray(x, float) if rest is None else rest
    a, b, x, left = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    out = np.where((x >= 1) & (left > 0), np.nan, out)
    inside = (x > 0) & (left > 0)
    if not inside.any():
        return out
    a, b, x, left = a[inside], b[inside], x[inside], left[inside]
    part = np.full(a.shape, np.nan)
    large = np.minimum(a, b) > _LARGE
    if large.any():
        part[large] = _lower_beta_large(a[large], b[large], x[large])
    # one side far larger than the other: the gamma limit, exact to 1 / side squared
    for p, q, small, flip in ((a, b, left, False), (b, a, x, True)):
        one = np.isnan(part) & (p > 1e6 * np.maximum(q, 1) ** 1.5)
        if one.any():
            near = -(p[one] + (q[one] - 1) / 2) * np.log1p(-small[one])
            value = upper_gamma(q[one], near)
            part[one] = 1 - value if flip else value
    rest = np.isnan(part)
    if rest.any():
        part[rest] = _lower_beta_fraction(a[rest], b[rest], x[rest])
    out[inside] = np.clip(part, 0, 1)
    return out


def _lower_beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def terms(k):
        m = k // 2
        if k % 2:
            return -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), 1.0
        return m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), 1.0

    fraction = _continued(np.ones_like(y), terms)
    x0 = p / (p + q)
    d = y - x0
    power = -p * _log1p_rest(d / x0) - q * _log1p_rest(-d / (1 - x0))
    front = np.sqrt(q / (2 * math.pi * p * (p + q))) * np.exp(power + _stirling(p + q) - _stirling(p) - _stirling(q))
    part = front / fraction
    return np.where(swap, 1 - part, part)


def _valid(*columns: pd.Series) -> np.ndarray:
    return np.logical_and.reduce([np.isfinite(c.to_numpy(float, na_value=np.nan)) for c in columns])


def _masked(fn, *columns: pd.Series) -> pd.Series:
    ok = _valid(*columns)
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*[c.to_numpy(float, na_value=np.nan)[ok] for c in columns])
    return pd.Series(out).where(ok, None).astype("Float64")


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda s, d: lower_beta(d / 2, 0.5, d / (d + s * s), s * s / (d + s * s)), t, df)


@F.pandas_udf(DoubleType())
def _p_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _masked(lambda s, a, b: lower_beta(b / 2, a / 2, b / (b + a * s), a * s / (b + a * s)), f, df1, df2)


@F.pandas_udf(DoubleType())
def _p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda s, d: upper_gamma(d / 2, s / 2), x, df)


@F.pandas_udf(DoubleType())
def _p_normal(z: pd.Series) -> pd.Series:
    return _masked(lambda s: _erfc(np.abs(s) / math.sqrt(2)), z)


def kolmogorov_sf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    k = np.arange(1, 101)[:, None]
    with np.errstate(over="ignore"):
        total = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * np.maximum(x, 1e-3)[None, :] ** 2), axis=0)
    return np.where(x < 0.2, 1.0, np.clip(total, 0, 1))


@F.pandas_udf(DoubleType())
def _p_ks(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _masked(lambda s, a, b: kolmogorov_sf(s * np.sqrt(a * b / (a + b))), d, n1, n2)


def p_t(t: Column, df: Column) -> Column:
    return _p_t(t.cast("double"), df.cast("double"))


def p_f(f: Column, df1: Column, df2: Column) -> Column:
    return _p_f(f.cast("double"), df1.cast("double"), df2.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    return _p_chi2(x.cast("double"), df.cast("double"))


def p_normal(z: Column) -> Column:
    return _p_normal(z.cast("double"))


def p_ks(d: Column, n1: Column, n2: Column) -> Column:
    return _p_ks(d.cast("double"), n1.cast("double"), n2.cast("double"))


# Rational approximation of the normal quantile, relative error below 1.2e-9.
QUANTILE_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
QUANTILE_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
QUANTILE_EDGE = 0.02425  # share below which the tail form holds


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Value at ``x``; the first coefficient is that of the highest power."""
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p for 0 < p < 1, by built-in functions."""
    least = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.log(least))
    tail = polynomial(q, QUANTILE_TAIL[0]) / polynomial(q, QUANTILE_TAIL[1]) * F.when(p < 0.5, 1.0).otherwise(-1.0)
    r = p - 0.5
    middle = r * polynomial(r * r, QUANTILE_MIDDLE[0]) / polynomial(r * r, QUANTILE_MIDDLE[1])
    return F.when(least < QUANTILE_EDGE, tail).otherwise(middle)
