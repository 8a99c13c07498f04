"""Tail probabilities of Student's t and of F, for the few rows of a test table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def _student(t: float, df: float) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _fisher(f: float, d1: float, d2: float) -> float | None:
    if any(v is None or math.isnan(v) for v in (f, d1, d2)) or d1 <= 0 or d2 <= 0:
        return None
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_student(*x) for x in zip(t, df, strict=True)], dtype=float)

    return F.pandas_udf(p, T.DoubleType())(t.cast("double"), df.cast("double"))


def fisher_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F."""

    def p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([_fisher(*x) for x in zip(f, d1, d2, strict=True)], dtype=float)

    return F.pandas_udf(p, T.DoubleType())(f.cast("double"), d1.cast("double"), d2.cast("double"))
