"""Hourly demand and the dataset summary."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import floor_hour
from ..session import materialize
from .enrich import add_state
from .quality import DataValidationError, nan_to_null
from .quantiles import brackets, exact_quantiles


def aggregate_hourly(
    df: DataFrame,
    start: date | None = None,
    end: date | None = None,
    sites: list[int] | None = None,
) -> DataFrame:
    """Sum, count, mean and first timestamp per site and hour.

    ``start`` and ``end`` (days, both included) and ``sites`` filter the raw columns, so that they reach
    the scan of the log, which a filter on the computed hour does not. NaN counts as missing.

    All four aggregates combine on the map side, so a site with a third of the log still sends
    one row per hour and task. ``state`` is looked up after the aggregation when the input has none.
    """
    missing = [c for c in ("site_id", "timestamp", "sessions") if c not in df.columns]
    if missing:
        raise DataValidationError(f"Aggregation failed: no column {missing}")
    if not isinstance(df.schema["timestamp"].dataType, T.TimestampNTZType):
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    time = F.col("timestamp")
    if start is not None:
        df = df.filter(time >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(time < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    if sites is not None:
        df = df.filter(F.col("site_id").isin(list(sites)))
    df = nan_to_null(df, "sessions")
    keys = ["site_id"] + (["state"] if "state" in df.columns else [])
    for name in (*keys, "timestamp"):
        df = df.filter(F.col(name).isNotNull())
    hourly = (
        df.groupBy(*keys, floor_hour(F.col("timestamp")).alias("hour"))
        .agg(
            F.sum("sessions").alias("_sum"),
            F.count("sessions").alias("session_count"),
            F.min("timestamp").alias("first_timestamp"),
        )
        .withColumn("sessions", F.coalesce("_sum", F.lit(0.0)))
        .withColumn("avg_sessions", F.try_divide("_sum", "session_count"))
    )
    if "state" not in hourly.columns:
        hourly = add_state(hourly)
    return hourly.select(
        "site_id", "state", "hour", "sessions", "session_count", "avg_sessions", "first_timestamp"
    )


def latest_hour(df: DataFrame) -> Column:
    """The last hour of ``aggregate_hourly(df)``, found in the log itself without grouping it."""
    keys = [c for c in ("site_id", "state") if c in df.columns]
    for name in keys:
        df = df.filter(F.col(name).isNotNull())
    return df.select(floor_hour(F.max(F.col("timestamp").cast("timestamp_ntz")))).scalar()


def data_summary(df: DataFrame, approximate_median: bool = False) -> DataFrame:
    """One row: size, sites, time range, session statistics and nulls per column.

    The median is exact and computed without gathering the values in one task;
    ``approximate_median`` replaces it by a sketch. NaN counts as null.
    """
    df = nan_to_null(df, "sessions")
    time = "timestamp" if "timestamp" in df.columns else "hour"
    value = F.col("sessions")
    totals = [
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("site_id").alias("unique_sites"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
    ]
    if approximate_median:
        return df.agg(*totals, F.percentile_approx("sessions", 0.5, 10000).alias("median"))
    # The sketch of the median comes from the same pass; a scalar row is all that is kept of it.
    whole = {"median": 0.5}
    number = F.when(~F.isnan(value.cast("double")), value.cast("double")).alias("value")
    sketched = df.withColumn("value", number).agg(*totals, brackets(whole).alias("bounds"))
    sketched = materialize(sketched, "summary")
    bounds = sketched.select(F.lit("sessions").alias("feature"), "bounds").filter("bounds IS NOT NULL")
    median = exact_quantiles(df, ["sessions"], whole, bounds).select("median")
    return sketched.drop("bounds").withColumn("median", median.scalar())
