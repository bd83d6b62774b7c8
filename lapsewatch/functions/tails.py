"""Tail probabilities as Arrow-batched functions over report rows (one row per feature or pair)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def student_critical(alpha: float, dof: float) -> float:
    """The t with P(|T| >= t) = alpha, by bisection."""
    low, high = 0.0, 1.0
    while student_two_sided(high, dof) > alpha:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if student_two_sided(middle, dof) > alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def chi_square_upper(statistic: float, dof: float) -> float:
    """P(X >= statistic) for the chi-square distribution."""
    if math.isnan(statistic) or math.isnan(dof) or dof <= 0:
        return math.nan
    if statistic <= 0.0:
        return 1.0
    a, x = dof / 2.0, statistic / 2.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for n in range(1, 10_000):
        weight = -n * (n - a)
        b += 2.0
        d = 1.0 / (weight * d + b or tiny)
        c = b + weight / c or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def _batched(function):
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.vectorize(function, otypes=[float])(
            x.to_numpy(dtype=float), y.to_numpy(dtype=float)), index=x.index)
    return apply


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _batched(student_two_sided)(t, dof)


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return _batched(chi_square_upper)(statistic, dof)
