"""Rates, intervals and tests of experiments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import arrow_function, col

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054


def rate(hits: Column, trials: Column) -> Column:
    return F.when(trials > 0, hits / trials).otherwise(0.0)


def wilson(hits, trials, z: float = Z) -> Column:
    """struct(low, high) of a proportion; (0, 0) without trials."""
    n = col(trials).cast("double")
    p = col(hits) / F.nullif(n, F.lit(0.0))
    d = 1 + z**2 / F.nullif(n, F.lit(0.0))
    centre = (p + z**2 / (2 * F.nullif(n, F.lit(0.0)))) / d
    margin = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z**2 / (4 * F.nullif(n * n, F.lit(0.0)))) / d
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def z_score(h1, n1, h2, n2) -> Column:
    """Of the second proportion against the first, pooled."""
    a, b, m, n = col(h1), col(h2), col(n1).cast("double"), col(n2).cast("double")
    p = (a + b) / (m + n)
    se = F.sqrt(p * (1 - p) * (1 / m + 1 / n))
    return F.when((m > 0) & (n > 0) & (se > 0), (b / n - a / m) / se).otherwise(0.0)


def chi_square(h1, n1, h2, n2, correct: bool = True) -> Column:
    """Of the 2x2 table, with Yates' correction as usual for one."""
    a, c = col(h1).cast("double"), col(h2).cast("double")
    b, d = col(n1) - a, col(n2) - c
    n = a + b + c + d
    off = F.least(F.lit(0.5), F.abs(a * d - b * c) / n) * n if correct else F.lit(0.0)
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(bottom > 0, n * F.pow(F.abs(a * d - b * c) - off, F.lit(2.0)) / bottom).otherwise(0.0)


@arrow_function("double")
def two_sided_p(z: pd.Series) -> pd.Series:
    """There is no error function among the built-in ones; this runs on result rows."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))
