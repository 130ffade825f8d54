"""Two-sample drift tests per feature."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults
from ..functions.significance import ks_p_value, mann_whitney_p_value
from .quantiles import BUCKET, long_form, numeric_columns, sorted_counts

# Fixed value: subject of the alert.
ALERT_SUBJECT = "Data Drift Alert"


def common_columns(reference: DataFrame, new: DataFrame) -> list[str]:
    """Numeric columns that both samples have, in the order of the new one."""
    known = set(numeric_columns(reference))
    return [c for c in numeric_columns(new) if c in known]


def compare_samples(reference: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: sample sizes, Kolmogorov-Smirnov D, Mann-Whitney U of the reference, tie sum.

    Both statistics are sums or extremes over a sorted run of distinct values, so each bucket of
    the sorted order is reduced on its own and only the bucket totals are put in sequence.
    Rows are never numbered across buckets.
    """
    samples = (
        reference.select(*columns)
        .withColumn("_is_ref", F.lit(1))
        .unionByName(new.select(*columns).withColumn("_is_ref", F.lit(0)))
    )
    counts = sorted_counts(
        long_form(samples, columns, keep=("_is_ref",)),
        F.sum("_is_ref").alias("ref"),
        F.sum(1 - F.col("_is_ref")).alias("new"),
    )
    # One row per feature, so always small.
    sizes = F.broadcast(
        counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("new").alias("n_new"))
    )
    up_to = Window.partitionBy(*BUCKET).orderBy("value")
    ties = F.col("ref") + F.col("new")
    placed = (
        counts.withColumn("_ref_to", F.sum("ref").over(up_to))
        .withColumn("_new_to", F.sum("new").over(up_to))
        .join(sizes, "feature")
        .withColumn(
            "_gap",
            F.try_divide("_ref_to", "n_ref") - F.try_divide("_new_to", "n_new"),
        )
    )
    mean_rank = F.col("_ref_to") + F.col("_new_to") - ties + (ties + 1) / 2
    cubes = ties.cast("double") * ties * ties - ties
    per_bucket = placed.groupBy(*BUCKET, "n_ref", "n_new").agg(
        F.sum("ref").alias("_ref"),
        F.sum("new").alias("_new"),
        F.max("_gap").alias("_highest"),
        F.min("_gap").alias("_lowest"),
        F.sum(F.col("ref") * mean_rank).alias("_ranks"),
        F.sum(cubes).alias("_cubes"),
    )
    so_far = Window.partitionBy("feature").orderBy("bucket")
    in_order = (
        per_bucket.withColumn("_ref_before", F.sum("_ref").over(so_far) - F.col("_ref"))
        .withColumn("_new_before", F.sum("_new").over(so_far) - F.col("_new"))
        .withColumn(
            "_base",
            F.try_divide("_ref_before", "n_ref") - F.try_divide("_new_before", "n_new"),
        )
    )
    rank_sum = F.sum(
        F.col("_ranks") + F.col("_ref") * (F.col("_ref_before") + F.col("_new_before"))
    )
    n_ref = F.col("n_ref").cast("double")
    return in_order.groupBy("feature", "n_ref", "n_new").agg(
        F.max(
            F.greatest(
                F.abs(F.col("_base") + F.col("_highest")), F.abs(F.col("_base") + F.col("_lowest"))
            )
        ).alias("ks_statistic"),
        (rank_sum - n_ref * (n_ref + 1) / 2).alias("mw_statistic"),
        F.sum("_cubes").alias("tie_sum"),
    )


def detect_drift(
    reference: DataFrame,
    new: DataFrame,
    significance_level: float = defaults.SIGNIFICANCE_LEVEL,
    min_sample: int = defaults.MIN_DRIFT_SAMPLE,
    ks_method: str = "limit",
) -> DataFrame:
    """One row per tested feature with both tests and the drift flags.

    Features with fewer than ``min_sample`` new values are not tested. For ``ks_method`` see
    ``ks_p_value``.
    """
    tested = compare_samples(reference, new, common_columns(reference, new)).filter(
        (F.col("n_new") >= min_sample) & (F.col("n_ref") > 0)
    )
    ks = ks_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_new"), ks_method)
    mw = mann_whitney_p_value(
        F.col("mw_statistic"), F.col("n_ref"), F.col("n_new"), F.col("tie_sum")
    )
    return (
        tested.withColumns({"ks_p_value": ks, "mw_p_value": mw})
        .withColumn("ks_drift", F.col("ks_p_value") < significance_level)
        .withColumn("mw_drift", F.col("mw_p_value") < significance_level)
        .withColumn("drift_detected", F.col("ks_drift") | F.col("mw_drift"))
        .drop("tie_sum")
    )


def drift_summary(report: DataFrame, new: DataFrame) -> DataFrame:
    """One row over the report. All numeric columns of the new data count, tested or not."""
    total = len(numeric_columns(new))
    drifted = F.when(F.col("drift_detected"), F.col("feature"))
    return report.agg(
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift_detected"),
        F.lit(total).alias("total_features_tested"),
        F.count(drifted).alias("features_with_drift"),
        F.concat_ws(", ", F.sort_array(F.collect_list(drifted))).alias("drifted_features"),
        F.try_divide(F.count(drifted) * 100.0, F.lit(total)).alias("drift_percentage"),
    )


def drift_alerts(summary: DataFrame, timestamp: datetime) -> DataFrame:
    """A subject and a message if drift was found, otherwise no row."""
    message = F.format_string(
        "%d features have moved: %s\nThat is %.1f%% of all numeric features.\nChecked for: %s\n"
        "Look at the new data before the next training run.",
        "features_with_drift",
        "drifted_features",
        "drift_percentage",
        F.lit(timestamp.isoformat()),
    )
    return summary.filter("drift_detected").select(
        F.lit(ALERT_SUBJECT).alias("subject"), message.alias("message")
    )
