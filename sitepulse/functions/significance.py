"""p-values. They are evaluated on one row per feature or metric, after all aggregation."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send these small functions by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = 100  # of Kolmogorov's series
STEPS = 1024  # of a numerical integral
REACH = 6.5  # beyond this exp(-x * x) is below 1e-18

def _ks_exact(d: float, m: int, n: int) -> float:
    """Chance that a random ordering of the two samples reaches a gap of at least ``d``.

    Walks through the merged sample. ``mass[i]`` is the chance to have seen i values of the
    first sample by now without reaching the gap; what leaves the band is added up.
    """
    unit = math.gcd(m, n)
    gap = round(d * m * n / unit) * unit  # the gap on the common grid of m * n steps
    if gap == 0:
        return 1.0
    reached, low, mass = 0.0, 0, np.ones(1)
    for seen in range(m + n):
        i = np.arange(low, low + len(mass))
        left = m + n - seen
        step = np.zeros(len(mass) + 1)
        step[1:] = mass * (m - i) / left
        step[:-1] += mass * (n - (seen - i)) / left
        at = np.arange(low, low + len(step))
        inside = np.abs(at * n - (seen + 1 - at) * m) < gap
        reached += step[~inside].sum()
        if not inside.any():
            break
        first = int(inside.argmax())
        kept = int(inside.sum())
        low, mass = low + first, step[first : first + kept]
    return min(1.0, reached)


@F.pandas_udf(T.DoubleType())
def _ks_exact_column(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_ks_exact(*row) for row in zip(d, m, n)], dtype=float)


def _simpson(height: Callable[[Column], Column], start: Column, stop: Column) -> Column:
    """Integral of ``height`` by Simpson's rule with a fixed number of steps."""
    step = (stop - start) / STEPS

    def add(total: Column, k: Column) -> Column:
        weight = F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * height(start + step * k)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), add) * step / 3


def ks_p_value(d: Column, n_ref: Column, n_new: Column, method: str = "limit") -> Column:
    """Two-sided p-value of the two-sample Kolmogorov-Smirnov statistic.

    ``limit`` is Kolmogorov's series with a correction for the effective sample size, the same for all
    sizes. ``exact`` walks through all orderings of one feature in one task, in a time that grows
    with the product of the sizes; the caller chooses it, never the number of rows.
    """
    if method == "exact":
        return _ks_exact_column(d, n_ref, n_new)
    if method != "limit":
        raise ValueError(f"Unknown method {method}")
    m, n = n_ref.cast("double"), n_new.cast("double")
    size = F.greatest(F.round(m * n / (m + n)), F.lit(1.0))
    root = F.sqrt(size)
    x = root * d + 1 / (6 * root) + (root * d - 1) / (4 * size)

    def add(total: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        return total + sign * F.exp(-2.0 * k * k * x * x)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), add)
    # below 0.2 the value is 1 to more than 20 digits, and the terms no longer fade
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def mann_whitney_p_value(u: Column, n_ref: Column, n_new: Column, tie_sum: Column) -> Column:
    """Two-sided normal p-value of U with tie and continuity correction."""
    m, n = n_ref.cast("double"), n_new.cast("double")
    total = m + n
    variance = m * n / 12 * ((total + 1) - tie_sum / (total * (total - 1)))
    z = (F.abs(u - m * n / 2) - 0.5) / F.sqrt(F.when(variance > 0, variance))
    x = z / math.sqrt(2)
    tail = _simpson(lambda s: F.exp(-s * s - 2 * x * s), F.lit(0.0), F.lit(REACH))
    p = 2 / math.sqrt(math.pi) * F.exp(-x * x) * tail
    return F.when(F.coalesce(z, F.lit(0.0)) <= 0, 1.0).otherwise(F.least(p, F.lit(1.0)))


def student_t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value for any degrees of freedom, in a fixed number of steps.

    With ``t = sqrt(df) tan(angle)`` the density is proportional to ``cos(angle) ** (df - 1)``; both the
    tail and the whole are integrated over the angles where it is above exp(-72).
    """
    freedom = df.cast("double")
    end = F.least(F.lit(math.pi / 2), 12 / F.sqrt(freedom))
    begin = F.least(F.atan(F.abs(t) / F.sqrt(freedom)), end)

    def density(angle: Column) -> Column:
        return F.exp((freedom - 1) * F.log(F.greatest(F.cos(angle), F.lit(1e-300))))

    return F.least(_simpson(density, begin, end) / _simpson(density, F.lit(0.0), end), F.lit(1.0))
