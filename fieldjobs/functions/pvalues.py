"""Tail probabilities for the few rows that statistics end in. Plain Python; scipy is not needed."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            out *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * out


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return _beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def chi2_upper(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def f_quantile(p: float, d1: float, d2: float) -> float:
    low, high = 0.0, 1.0
    cdf = lambda f: _beta(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))
    while cdf(high) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _udf(f: Callable) -> Callable[..., Column]:
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, x)) if all(v is not None and v == v for v in x) else None for x in zip(*cols)], dtype="float64")

    names = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}

    def made(*cols) -> Column:
        g = names[len(cols)]
        g.__annotations__ = {k: pd.Series for k in ["a", "b", "c"][: len(cols)]} | {"return": pd.Series}
        return F.pandas_udf(g, "double")(*cols)

    return made


p_of_t = _udf(t_two_sided)
p_of_chi2 = _udf(chi2_upper)
quantile_of_f = _udf(f_quantile)


def p_of_r(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, by t with n - 2 degrees of freedom; 0 if |r| is 1, null under three pairs."""
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(p_of_t(t, (n - 2).cast("double")))
