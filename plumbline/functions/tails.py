"""Probability tails that Spark has no built-in for; applied to a handful of result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail of a standardised statistic."""

    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v is None or v != v else min(1.0, math.erfc(v / math.sqrt(2))))

    return F.pandas_udf(tail, "double", F.PandasUDFType.SCALAR)(z)


def chi_square_tail(x: float, df: int) -> float:
    """Upper chi-square tail by the finite sums for odd and even degrees of freedom."""
    if x is None or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    if df % 2:
        total, term = 0.0, 1.0
        for j in range((df - 1) // 2):
            term = 1.0 if j == 0 else term * x / (2 * j + 1)
            total += term
        return min(1.0, math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total)
    total, term = 0.0, 1.0
    for j in range(df // 2):
        term = 1.0 if j == 0 else term * (x / 2) / j
        total += term
    return min(1.0, math.exp(-x / 2) * total)


def chi_square_p(x: Column, df: Column) -> Column:
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(a, int(b)) for a, b in zip(x, df)])

    return F.pandas_udf(tail, "double", F.PandasUDFType.SCALAR)(x, df)
