"""Special functions: those with a short closed form as columns, the others as vectorised pandas functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers: shifted by eight, then Stirling's series."""
    y = x + 8
    below = F.lit(0.0)
    for i in range(8):
        below = below + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return F.when(x > 0, (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below)


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """The probability that Kolmogorov's statistic, times the root of the sample, exceeds x."""
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + term(k))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def wigner_density(s: Column) -> Column:
    return math.pi / 2 * s * F.exp(-math.pi / 4 * s * s)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Null outside (0, 1)."""
    normal = NormalDist()
    return pd.Series([normal.inv_cdf(x) if 0 < x < 1 else None for x in p], dtype="float64")


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    value = 0.0
    for n in range(200 + int(4 * math.sqrt(a)), 0, -1):  # from the tail to the front
        value = n * (n - a) / (x + 2 * n + 1 - a - value)
    return front / (x + 1 - a - value)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([upper_gamma(k / 2, v / 2) for v, k in zip(x, degrees, strict=True)])


@F.pandas_udf(T.DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantiles of Beta(a, b), a, b >= 1, by adding up the density on a grid about the bulk."""
    out = []
    for q, x, y in zip(p, a, b, strict=True):
        mean, sd = x / (x + y), math.sqrt(x * y / (x + y + 1)) / (x + y)
        grid = np.linspace(max(0.0, mean - 12 * sd), min(1.0, mean + 12 * sd), 20_001)
        logs = (x - 1) * np.log(np.maximum(grid, 1e-300)) + (y - 1) * np.log(np.maximum(1 - grid, 1e-300))
        density = np.exp(logs - logs.max())
        mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
        out.append(float(np.interp(q, mass / mass[-1], grid)))
    return pd.Series(out)
