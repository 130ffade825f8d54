"""Model performance over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions.calendar import moment
from ..functions.metrics import METRICS, regression_metrics
from ..functions.significance import student_t_p_value
from .ranks import with_row_index

# Trend labels and subject of the alert.
STABLE, INCREASING, DECREASING, TOO_FEW = "stable", "increasing", "decreasing", "insufficient_data"
ALERT_SUBJECT = "Performance Degradation Alert"


def performance_records(scored: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """One record per scoring time from rows with ``actual`` and ``predicted``."""
    return scored.groupBy(timestamp).agg(*regression_metrics())


def _by_metric(records: DataFrame, keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    return records.unpivot(list(keep), list(METRICS), "metric", "value")


def degraded_metrics(
    records: DataFrame,
    baseline: DataFrame,
    threshold: float = defaults.DEGRADATION_THRESHOLD,
) -> DataFrame:
    """Metrics that are worse than ``baseline`` (``metric, value``) by more than ``threshold``.

    Errors degrade upwards, R2 downwards. Metrics without a baseline are not checked.
    """
    twice = F.raise_error(F.lit("a metric has several baseline values")).cast("double")
    known = baseline.filter(F.col("metric").isin(*METRICS)).groupBy("metric").agg(
        F.when(F.min("value") != F.max("value"), twice).otherwise(F.max("value")).alias("baseline")
    )
    worse_by = F.when(F.col("metric") == "r2", F.col("baseline") - F.col("value")).otherwise(
        F.col("value") - F.col("baseline")
    )
    degradation = F.try_divide(worse_by, F.col("baseline"))
    # One baseline row per metric name.
    return (
        _by_metric(records)
        .join(F.broadcast(known), "metric")
        .withColumn("_degradation", degradation)
        .filter(F.col("_degradation") > threshold)
        .select(
            "timestamp",
            "metric",
            "baseline",
            F.col("value").alias("current"),
            (F.col("_degradation") * 100).alias("degradation_pct"),
        )
    )


def performance_alerts(degraded: DataFrame, model_name: str) -> DataFrame:
    """One subject and message per record time, listing its degraded metrics."""
    line = F.format_string(
        "%s is %.4f and was %.4f: worse by %.1f percent",
        "metric",
        "current",
        "baseline",
        "degradation_pct",
    )
    # At most one line per metric name and record time.
    lines = F.array_join(F.sort_array(F.collect_list("_line")), "\n")
    return (
        degraded.withColumn("_line", line)
        .groupBy("timestamp")
        .agg(lines.alias("_lines"))
        .select(
            "timestamp",
            F.lit(ALERT_SUBJECT).alias("subject"),
            F.concat_ws(
                "\n",
                F.lit(f"Model: {model_name}"),
                F.lit("Worse than the baseline:"),
                "_lines",
                F.lit("Look at the recent data or train again."),
            ).alias("message"),
        )
    )


def recent_records(
    records: DataFrame, as_of: datetime, days: int = defaults.SUMMARY_DAYS
) -> DataFrame:
    """Records of the last ``days`` days before ``as_of``."""
    return records.filter(F.col("timestamp") >= moment(as_of - timedelta(days=days)))


def _trend_label(n: Column, slope: Column, p_value: Column) -> Column:
    return (
        F.when(n < 2, TOO_FEW)
        .when(p_value > 0.05, STABLE)
        .when(slope > 0, INCREASING)
        .otherwise(DECREASING)
    )


def metric_trend(records: DataFrame) -> DataFrame:
    """Least-squares slope per metric over the record order, its p-value and a label.

    Records are indexed by a distributed sort, not by one task. Rows without a value are
    left out of the fit but keep their place in the order.
    """
    indexed = with_row_index(records.select("timestamp", *METRICS), "timestamp", *METRICS)
    fits = (
        _by_metric(indexed, keep=("row_index",))
        .filter(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(
            F.count("value").alias("n"),
            F.regr_slope("value", "row_index").alias("slope"),
            F.regr_sxy("value", "row_index").alias("_sxy"),
            F.regr_sxx("value", "row_index").alias("_sxx"),
            F.regr_syy("value", "row_index").alias("_syy"),
            (F.min("value") == F.max("value")).alias("_constant"),
        )
    )
    freedom = F.col("n") - 2
    r = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    unexplained = (1 - r) * (1 + r)
    t = r * F.sqrt(freedom / F.when(unexplained > 0, unexplained))
    p_value = (
        F.when(F.col("n") < 2, F.lit(None))
        .when(F.col("_constant"), 1.0)
        .when((F.col("n") == 2) | (unexplained <= 0), 0.0)
        .otherwise(student_t_p_value(t, freedom))
    )
    return fits.withColumn("p_value", p_value).select(
        "metric", "n", "slope", "p_value", _trend_label(F.col("n"), F.col("slope"), F.col("p_value")).alias("trend")
    )


def performance_summary(
    records: DataFrame, as_of: datetime, days: int = defaults.SUMMARY_DAYS
) -> DataFrame:
    """Per metric: mean, population deviation, range and trend over the last ``days`` days.

    Empty when there is no recent record.
    """
    recent = recent_records(records, as_of, days)
    stats = (
        recent.unpivot(["timestamp", "sample_size"], list(METRICS), "metric", "value")
        .groupBy("metric")
        .agg(
            F.lit(days).alias("period_days"),
            F.sum("sample_size").alias("total_predictions"),
            F.count(F.lit(1)).alias("num_evaluations"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    return stats.join(metric_trend(recent).select("metric", "trend"), "metric", "left").withColumn(
        "trend", F.coalesce("trend", F.lit(TOO_FEW))
    )
