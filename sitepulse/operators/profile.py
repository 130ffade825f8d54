"""Column statistics: correlations, histograms and quartiles."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions.comoments import pair_correlations
from ..session import materialize
from .quantiles import brackets, exact_quantiles, long_form, numeric_columns

# Column families by a part of the column name.
FEATURE_FAMILIES = {
    "Temporal": ("hour", "day", "month", "year"),
    "Rolling Stats": ("rmean", "rstd", "rmin", "rmax"),
    "Lag": ("lag",),
    "Binary": ("is_",),
}
DEFAULT_FAMILIES = ("Temporal", "Rolling Stats")
KEY_COLUMNS = ("site_id", "hour")


def _constant(x: Column) -> Column:
    """Whether all values are equal. A variance merged from several tasks need not be exactly 0."""
    return F.min(x) == F.max(x)


def _names(columns: list[str], index: str) -> Column:
    return F.array(*[F.lit(c) for c in columns])[F.col(index)]


def correlation_with_target(
    df: DataFrame, target: str = "sessions", columns: list[str] | None = None
) -> DataFrame:
    """Correlation of each numeric column with the target, ascending, and its sign flag."""
    if columns is None:
        columns = numeric_columns(df, exclude=(*KEY_COLUMNS, target))
    pairs = [(i, len(columns)) for i in range(len(columns))]
    return (
        pair_correlations(df, [*columns, target], pairs)
        .select(
            _names(columns, "a").alias("feature"),
            "correlation",
            F.coalesce(F.col("correlation") > 0, F.lit(False)).alias("is_positive"),
        )
        .orderBy(F.asc_nulls_last("correlation"), "feature")
    )


def family_columns(df: DataFrame, families: tuple[str, ...] = DEFAULT_FAMILIES) -> list[str]:
    """Numeric columns of the chosen families without repeats, ``sessions`` included."""
    return family_columns_of(numeric_columns(df, exclude=KEY_COLUMNS), families)


def family_columns_of(names: list[str], families: tuple[str, ...] = DEFAULT_FAMILIES) -> list[str]:
    picked = [c for f in families for c in names if any(p in c for p in FEATURE_FAMILIES[f])]
    return list(dict.fromkeys([*picked, "sessions"]))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every two columns (upper triangle) as rows ``feature_a, feature_b``.

    A task sends on one block for all pairs, whatever its number of rows.
    """
    if columns is None:
        columns = family_columns(df)
    pairs = list(itertools.combinations(range(len(columns)), 2))
    return pair_correlations(df, columns, pairs).select(
        _names(columns, "a").alias("feature_a"), _names(columns, "b").alias("feature_b"), "correlation"
    )


def histogram(
    df: DataFrame, columns: list[str], bins: int = defaults.HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum falls in the last bin.

    Bins without rows are left out. A constant column gets one bin.
    """
    values = long_form(df, columns)
    ranges = values.groupBy("feature").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("_min"), width)), F.lit(0))
    # One range per column.
    binned = values.join(F.broadcast(ranges), "feature").select(
        "feature", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "_min", width.alias("_width")
    )
    return (
        binned.groupBy("feature", "bin", "_min", "_width")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "feature",
            "bin",
            (F.col("_min") + F.col("bin") * F.col("_width")).alias("lower"),
            (F.col("_min") + (F.col("bin") + 1) * F.col("_width")).alias("upper"),
            "count",
        )
    )


def _with_quantiles(df: DataFrame, columns: list[str], quantiles: dict[str, float], *moments: Column) -> DataFrame:
    """``moments`` of ``value`` and exact quantiles per column; ``df`` is read twice."""
    found = long_form(df, columns).groupBy("feature").agg(*moments, brackets(quantiles).alias("bounds"))
    found = materialize(found, "moments")  # a row per column
    exact = exact_quantiles(df, columns, quantiles, found.select("feature", "bounds"))
    return found.drop("bounds").join(exact, "feature")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles and maximum per column, all exact."""
    ends = F.min("value").alias("min"), F.max("value").alias("max")
    found = _with_quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}, *ends)
    return found.select("feature", "min", "q25", "median", "q75", "max")


def reference_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, range and quartiles of every numeric column. Skewness and kurtosis are biased."""
    if columns is None:
        columns = numeric_columns(df)
    value = F.col("value")
    moments = (
        F.avg(value).alias("mean"),
        F.when(_constant(value) & (F.count(value) > 1), 0.0)
        .otherwise(F.stddev_samp(value))
        .alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.when(~_constant(value), F.skewness(value)).alias("skewness"),
        F.when(~_constant(value), F.kurtosis(value)).alias("kurtosis"),
    )
    return _with_quantiles(df, columns, {"median": 0.5, "q25": 0.25, "q75": 0.75}, *moments).select(
        "feature", "mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis"
    )
