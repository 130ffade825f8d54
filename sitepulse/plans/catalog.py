"""The registered queries: every operator applied to the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import floor_hour, moment
from ..functions.metrics import METRICS, regression_metrics
from ..operators import drift, enrich, features, performance, profile, quality, rollups, split
from ..operators import requests as request_ops
from ..operators.hourly import aggregate_hourly, data_summary, latest_hour
from ..operators.ranks import with_row_index
from ..session import shared_dir
from ..sources import hourly_store, reports
from ..sources.event_log import EVENT_SCHEMA, sessions_from_events
from ..sources.sessions import load_sessions, prepare_sessions, unreadable_sessions
from ..streaming.scoring import start_answering, start_scoring
from . import model as forecast
from . import training
from .scoring import prediction_interval, score_requests

Query = Callable[[SparkSession, str], DataFrame]

# The periods that the drift and degradation queries compare.
SPLIT_DAY = datetime(2024, 1, 16)
AS_OF = datetime(2024, 1, 31)
SUMMARY_DAYS = 14
DATE_RANGE = (date(2024, 1, 5), date(2024, 1, 20))
MODEL_QUERIES = (
    "predictions",
    "actual_vs_predicted",
    "feature_importance",
    "saved_model",
    "request_scores",
    "streamed_scores",
    "baseline_model",
    "cross_validation",
    "training_results",
    "parameter_tuning",
    "prediction_rows",
    "comparison_actuals",
    "importance_names",
    "fold_scores",
    "tuning_points",
    "training_result_rows",
    "baseline_scores",
    "request_score_rows",
    "streamed_score_rows",
    "answered_requests",
)
CHUNK_ROWS = 200  # small, so that series really are cut in the given tables
HISTOGRAM_COLUMNS = ["sessions", "hour_of_day", "day_of_week", "is_weekend", "month"]
BOX_COLUMNS = ["sessions", "session_count", "avg_sessions"]
ALIGNED = ["lag_24", "hour_of_day", "not_computed", "rmean_24"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, whose last digits depend on the order of summation.

    Rounding happens on decimals with three more digits, so that a mean lying exactly between
    two results always goes the same way.
    """
    exact = f"decimal(28,{digits + 3})"
    return df.select(
        *[
            F.round(F.col(f.name).cast(exact), digits).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else f.name
            for f in df.schema.fields
        ]
    )


def sessions(spark: SparkSession, sf_dir: str, sites: int = 10) -> DataFrame:
    return sessions_from_events(spark, sf_dir, sites).drop("event_id")


def dirty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with repeated keys, negative values and nulls."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return events.select(
        (F.col("user_id") % 10 + 1).alias("site_id"),
        floor_hour(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("value") - 20).alias("sessions"),
        "event_id",
    )


def hourly(spark: SparkSession, sf_dir: str, sites: int = 10) -> DataFrame:
    return aggregate_hourly(sessions(spark, sf_dir, sites))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.create_feature_table(hourly(spark, sf_dir), include_interactions=True)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_rows(sessions(spark, sf_dir))


def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(spark, sf_dir).select("site_id", "hour", "sessions")


def naive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous value of a site as a forecast of the next one."""
    lagged = features.add_lag_features(hourly(spark, sf_dir), lag_periods=(1,))
    return lagged.filter(F.col("lag_1").isNotNull()).select(
        "site_id",
        "hour",
        F.to_date("hour").cast("timestamp_ntz").alias("timestamp"),
        F.col("sessions").alias("actual"),
        F.col("lag_1").alias("predicted"),
    )


def daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.performance_records(naive_scores(spark, sf_dir))


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = naive_scores(spark, sf_dir).filter(F.col("hour") < moment(SPLIT_DAY))
    return early.agg(*regression_metrics()).unpivot([], list(METRICS), "metric", "value")


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.degraded_metrics(daily_records(spark, sf_dir), baseline_metrics(spark, sf_dir))


def value_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    early = F.col("ts") < moment(SPLIT_DAY)
    return events.filter(early).select("value"), events.filter(~early).select("value")


def hourly_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = features.add_temporal_features(hourly(spark, sf_dir), include_cyclical=False)
    early = F.col("hour") < moment(SPLIT_DAY)
    columns = [
        "site_id", "sessions", "session_count", "avg_sessions", "hour_of_day", "is_weekend",
        "day_of_month",
    ]
    late_only = "quarter"
    return (
        rows.filter(early).select(*columns),
        rows.filter(~early).select(*columns, late_only),
    )


def value_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.compare_samples(*value_samples(spark, sf_dir), ["value"])


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.detect_drift(*hourly_samples(spark, sf_dir))


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_summary(drift_report(spark, sf_dir), hourly_samples(spark, sf_dir)[1])


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One well-formed request per hourly row, with null lags where a series begins."""
    rows = (
        hourly(spark, sf_dir)
        .transform(features.add_temporal_features)
        .transform(features.add_lag_features, lag_periods=(1, 24))
        .transform(features.add_rolling_features, windows=(24,))
    )
    return rows.select(
        "site_id",
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "hour_of_day",
        "day_of_week",
        "is_weekend",
        "hour_sin",
        "hour_cos",
        "lag_1",
        "lag_24",
        "rmean_24",
    )


def bad_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log with every kind of rule broken somewhere."""
    site, day = F.col("site_id"), F.col("day_of_week")
    stamp = F.col("timestamp")
    return request_log(spark, sf_dir).select(
        (site - 1).alias("site_id"),
        F.when(site == 3, "not-a-timestamp")
        .when(site == 4, F.replace(stamp, F.lit("2024-01"), F.lit("2024-13")))
        .when(site == 5, F.concat(F.lit("2024-01-32"), F.substring(stamp, 11, 10)))
        .when(site == 6, F.substring(stamp, 1, 10))
        .otherwise(stamp)
        .alias("timestamp"),
        (F.col("hour_of_day") + 2).alias("hour_of_day"),
        (day + 1).alias("day_of_week"),
        (F.col("is_weekend") * 2).alias("is_weekend"),
        F.when(site != 7, F.col("hour_sin")).alias("hour_sin"),
        (F.col("hour_cos") * 1.5).alias("hour_cos"),
        (F.col("lag_1") - 20).alias("lag_1"),
        "lag_24",
        "rmean_24",
    )


def split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    return training.prepare_data(sessions(spark, sf_dir))


def default_fit(spark: SparkSession, sf_dir: str):
    """The demand model with default parameters and early stopping, and its test rows."""
    rows, names = split_rows(spark, sf_dir)
    model = forecast.fit(rows.filter("split = 'train'"), names, rows.filter("split = 'validation'"))
    return model, rows.filter("split = 'test'")


def q_load_sessions(spark, sf_dir):
    raw = sessions_from_events(spark, sf_dir, 25)
    return rounded(prepare_sessions(raw, ("event_id",)).drop("event_id"))


def written_log(spark: SparkSession, sf_dir: str, file_format: str) -> str:
    """The log with repeated keys as several files in the order of the events, and as CSV with text in
    place of some numbers."""
    rows = dirty_sessions(spark, sf_dir)
    if file_format == "csv":
        rows = rows.withColumn("sessions", F.coalesce(F.col("sessions").cast("string"), F.lit("n/a")))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    ordered.write.option("header", True).format(file_format).save(path)
    return path


def q_load_sessions_csv(spark, sf_dir):
    return rounded(load_sessions(spark, written_log(spark, sf_dir, "csv")).drop("event_id"))


def q_load_sessions_parquet(spark, sf_dir):
    path = written_log(spark, sf_dir, "parquet")
    return rounded(load_sessions(spark, path, "parquet").drop("event_id"))


def q_unreadable_sessions(spark, sf_dir):
    found = unreadable_sessions(spark, written_log(spark, sf_dir, "csv"))
    return found.select(F.concat_ws(",", "columns").alias("columns"), "text")


def q_validate_report(spark, sf_dir):
    return quality.validation_report(dirty_sessions(spark, sf_dir))


def q_dedupe_sessions(spark, sf_dir):
    return rounded(quality.deduplicate(dirty_sessions(spark, sf_dir), order_by=("event_id",)))


def q_clip_sessions(spark, sf_dir):
    return rounded(quality.clip_negative(dirty_sessions(spark, sf_dir)))


def q_clean_sessions(spark, sf_dir):
    return rounded(quality.clean_data(dirty_sessions(spark, sf_dir), order_by=("event_id",)))


def q_training_rows(spark, sf_dir):
    return rounded(training_rows(spark, sf_dir))


def q_site_comparison(spark, sf_dir):
    return rounded(rollups.site_comparison(hourly(spark, sf_dir)))


def q_add_state(spark, sf_dir):
    return rounded(enrich.add_state(sessions_from_events(spark, sf_dir, 25)))


def q_unmapped_sites(spark, sf_dir):
    return enrich.unmapped_sites(sessions(spark, sf_dir, 25))


def q_station_status(spark, sf_dir):
    return rounded(enrich.station_status(hourly(spark, sf_dir), latest_hour(sessions(spark, sf_dir))))


def q_new_sites(spark, sf_dir):
    return rollups.new_sites(hourly(spark, sf_dir, 1000), latest_hour(sessions(spark, sf_dir, 1000)))


def q_hourly_agg(spark, sf_dir):
    return rounded(hourly(spark, sf_dir, 25))


def q_hourly_agg_dirty(spark, sf_dir):
    return rounded(aggregate_hourly(dirty_sessions(spark, sf_dir)))


def q_data_summary(spark, sf_dir):
    return rounded(data_summary(dirty_sessions(spark, sf_dir).drop("event_id")))


def q_temporal_features(spark, sf_dir):
    base = hourly(spark, sf_dir).select("site_id", "hour")
    return rounded(features.add_temporal_features(base))


def _series(spark, sf_dir):
    return hourly(spark, sf_dir).select("site_id", "hour", "sessions")


def q_lag_features(spark, sf_dir):
    return rounded(features.add_lag_features(_series(spark, sf_dir)))


def q_rolling_features(spark, sf_dir):
    return rounded(features.add_rolling_features(_series(spark, sf_dir)))


def q_difference_features(spark, sf_dir):
    return rounded(features.add_difference_features(_series(spark, sf_dir)))


def q_interaction_features(spark, sf_dir):
    table = features.add_lag_features(features.add_temporal_features(_series(spark, sf_dir)))
    named = [f"{a}_x_{b}" for a, b in features.defaults.INTERACTION_PAIRS]
    return rounded(features.add_interaction_features(table).select("site_id", "hour", *named))


def q_feature_table(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


def q_feature_table_in_chunks(spark, sf_dir):
    table = features.create_feature_table(
        hourly(spark, sf_dir), include_interactions=True, chunk_rows=CHUNK_ROWS
    )
    return rounded(table)


def q_state_rollup(spark, sf_dir):
    return rounded(rollups.state_rollup(hourly(spark, sf_dir, 25)))


def q_state_hour_profile(spark, sf_dir):
    return rounded(rollups.state_hour_profile(hourly(spark, sf_dir)))


def q_daily_by_state(spark, sf_dir):
    table = aggregate_hourly(sessions(spark, sf_dir), *DATE_RANGE)
    return rounded(rollups.daily_by_state(table, *DATE_RANGE))


def q_daily_total(spark, sf_dir):
    return rounded(rollups.daily_total(hourly(spark, sf_dir)))


def q_demand_heatmap(spark, sf_dir):
    return rounded(rollups.demand_heatmap(hourly(spark, sf_dir)))


def q_peak_hours(spark, sf_dir):
    return rounded(rollups.peak_hours(hourly(spark, sf_dir)))


def q_weekend_weekday(spark, sf_dir):
    return rounded(rollups.weekend_weekday(hourly(spark, sf_dir)))


def q_overview_metrics(spark, sf_dir):
    latest = latest_hour(sessions(spark, sf_dir))
    return rounded(rollups.overview_metrics(hourly(spark, sf_dir), latest))


def q_feature_correlation(spark, sf_dir):
    return rounded(profile.correlation_with_target(features.create_feature_table(hourly(spark, sf_dir))))


def q_correlation_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(features.create_feature_table(hourly(spark, sf_dir))))


def q_temporal_patterns(spark, sf_dir):
    return rounded(rollups.temporal_patterns(hourly(spark, sf_dir)))


def q_histogram(spark, sf_dir):
    table = features.add_temporal_features(hourly(spark, sf_dir))
    return rounded(profile.histogram(table, HISTOGRAM_COLUMNS))


def q_box_stats(spark, sf_dir):
    return rounded(profile.box_stats(hourly(spark, sf_dir), BOX_COLUMNS))


def q_state_metrics(spark, sf_dir):
    return rounded(rollups.state_metrics(hourly(spark, sf_dir)))


def q_site_tail(spark, sf_dir):
    tail = rollups.site_tail(hourly(spark, sf_dir))
    return rounded(tail.select("site_id", "hour", "sessions"))


def q_time_split(spark, sf_dir):
    return rounded(split.time_split(split_keys(spark, sf_dir)))


def q_random_split(spark, sf_dir):
    return rounded(split.random_split(split_keys(spark, sf_dir)))


def q_baseline_split(spark, sf_dir):
    return rounded(split.baseline_split(split_keys(spark, sf_dir)))


def q_ts_folds(spark, sf_dir):
    indexed = with_row_index(split_keys(spark, sf_dir), *split.TIME_ORDER)
    return split.fold_summary(indexed)


def q_align_features(spark, sf_dir):
    table = features.create_feature_table(hourly(spark, sf_dir))
    return rounded(features.align_features(table, ALIGNED, keep=("site_id", "hour")))


def q_regression_metrics(spark, sf_dir):
    return rounded(naive_scores(spark, sf_dir).agg(*regression_metrics()))


def q_validate_requests(spark, sf_dir):
    validated = request_ops.validate_requests(bad_request_log(spark, sf_dir))
    return validated.select("site_id", "timestamp", F.concat_ws(",", "rejects").alias("rejects"))


def q_request_features(spark, sf_dir):
    names = features.model_feature_names()
    keep = ("site_id", "timestamp")
    return rounded(request_ops.request_features(request_log(spark, sf_dir), names, keep))


def q_prediction_interval(spark, sf_dir):
    scores = naive_scores(spark, sf_dir).withColumn("i", prediction_interval(F.col("predicted")))
    return rounded(scores.select("site_id", "hour", "predicted", "i.lower", "i.upper"))


def q_reference_stats(spark, sf_dir):
    return rounded(profile.reference_stats(hourly(spark, sf_dir)))


def q_ks_statistic(spark, sf_dir):
    return rounded(
        value_comparison(spark, sf_dir).select("feature", "n_ref", "n_new", "ks_statistic"), 9
    )


def q_mann_whitney_u(spark, sf_dir):
    return rounded(
        value_comparison(spark, sf_dir).select(
            "feature", "n_ref", "n_new", "mw_statistic", "tie_sum"
        )
    )


def q_drift_report(spark, sf_dir):
    return rounded(drift_report(spark, sf_dir).drop("ks_p_value", "mw_p_value"))


def q_drift_p_values(spark, sf_dir):
    return rounded(drift_report(spark, sf_dir).select("feature", "ks_p_value", "mw_p_value"))


def q_drift_summary(spark, sf_dir):
    return rounded(drift_summary(spark, sf_dir))


def q_drift_alerts(spark, sf_dir):
    return drift.drift_alerts(drift_summary(spark, sf_dir), AS_OF)


def q_performance_records(spark, sf_dir):
    return rounded(daily_records(spark, sf_dir))


def q_degraded_metrics(spark, sf_dir):
    return rounded(degraded(spark, sf_dir))


def q_performance_alerts(spark, sf_dir):
    return performance.performance_alerts(degraded(spark, sf_dir), training.MODEL_NAME)


def q_performance_summary(spark, sf_dir):
    return rounded(
        performance.performance_summary(daily_records(spark, sf_dir), AS_OF, SUMMARY_DAYS)
    )


def q_metric_trend(spark, sf_dir):
    return rounded(performance.metric_trend(daily_records(spark, sf_dir)))


def q_performance_history(spark, sf_dir):
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    records, baseline = daily_records(spark, sf_dir), baseline_metrics(spark, sf_dir)
    early = F.col("timestamp") < moment(SPLIT_DAY)
    for part in (records.filter(early), records.filter(~early)):
        reports.save_performance_history(part, baseline, path, training.MODEL_NAME)
    return rounded(reports.load_performance_history(spark, path)[0])


def q_performance_history_cycle(spark, sf_dir):
    """Save, load, save what was loaded to the same place, and load again."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    saved = daily_records(spark, sf_dir), baseline_metrics(spark, sf_dir)
    for _ in range(2):
        reports.save_performance_history(*saved, path, training.MODEL_NAME)
        saved = reports.load_performance_history(spark, path)
    return rounded(saved[0])


def q_performance_history_compacted(spark, sf_dir):
    """Three saves, the second one repeated, put into one entry, and a save after that."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    records, baseline = daily_records(spark, sf_dir), baseline_metrics(spark, sf_dir)
    day = F.dayofmonth("timestamp") % 3
    for number in (0, 1, 1):
        reports.save_performance_history(records.filter(day == number), baseline, path, training.MODEL_NAME)
    reports.compact_performance_history(spark, path)
    reports.save_performance_history(records.filter(day == 2), baseline, path, training.MODEL_NAME)
    return rounded(reports.load_performance_history(spark, path)[0])


def hourly_store_of(spark: SparkSession, sf_dir: str, sites: int = 10) -> str:
    """A store that got the events in two batches, the second one twice."""
    path = f"{shared_dir(spark)}/hours-{uuid.uuid4().hex}"
    events = sessions_from_events(spark, sf_dir, sites)
    for batch in (0, 1, 1):
        part = events.filter(F.col("event_id") % 2 == batch).drop("event_id")
        hourly_store.add_batch(part, path, f"part-{batch}")
    return path


def q_hourly_store_update(spark, sf_dir):
    return rounded(hourly_store.read_hourly(spark, hourly_store_of(spark, sf_dir, 25)))


def q_stored_overview(spark, sf_dir):
    return rounded(hourly_store.stored_overview(spark, hourly_store_of(spark, sf_dir)))


def q_stored_station_status(spark, sf_dir):
    path = hourly_store_of(spark, sf_dir)
    last = hourly_store.latest_date(spark, path)
    hours = hourly_store.read_hourly(spark, path, last, last)
    return rounded(enrich.station_status(hours, hourly_store.latest_hour(spark, path)))


def q_stored_daily_by_state(spark, sf_dir):
    hours = hourly_store.read_hourly(spark, hourly_store_of(spark, sf_dir), *DATE_RANGE)
    return rounded(rollups.daily_by_state(hours, *DATE_RANGE))


def q_hourly_agg_nan(spark, sf_dir):
    """Values that are not a number count as missing."""
    raw = sessions(spark, sf_dir)
    value = F.when(F.col("sessions") >= 50, F.lit(float("nan"))).otherwise(F.col("sessions"))
    return rounded(aggregate_hourly(raw.withColumn("sessions", value)))


def q_predictions(spark, sf_dir):
    model, test = default_fit(spark, sf_dir)
    return forecast.predict(model, test, keep=("site_id", "hour"))


def q_actual_vs_predicted(spark, sf_dir):
    return forecast.comparison_series(*default_fit(spark, sf_dir))


def q_feature_importance(spark, sf_dir):
    return forecast.feature_importance(default_fit(spark, sf_dir)[0])


def q_saved_model(spark, sf_dir):
    """How far the predictions of the model that was read back are from those before saving."""
    model, test = default_fit(spark, sf_dir)
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    path = reports.save_named_model({training.MODEL_NAME: model}, training.MODEL_NAME, folder)
    both = (forecast.predict(m, test, keep=("site_id", "hour")) for m in (model, forecast.load_model(path)))
    before, after = (rows.withColumnRenamed("prediction", name) for name, rows in zip(("_a", "_b"), both))
    gap = F.abs(F.col("_a") - F.col("_b")).alias("prediction_gap")
    return before.join(after, ["site_id", "hour"]).select("site_id", "hour", gap)


def q_cross_validation(spark, sf_dir):
    rows, names = split_rows(spark, sf_dir)
    train = training.indexed_training_part(rows)
    return forecast.cross_validate(train, names)


def q_parameter_tuning(spark, sf_dir):
    rows, names = split_rows(spark, sf_dir)
    train = training.indexed_training_part(rows)
    return forecast.tune(train, names)[2]


def q_training_results(spark, sf_dir):
    folder = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    training.run_training(sessions(spark, sf_dir), folder)
    return reports.load_training_results(spark, folder)


def q_baseline_model(spark, sf_dir):
    return training.baseline_fit(sessions(spark, sf_dir))[1]


def q_request_scores(spark, sf_dir):
    model, _ = default_fit(spark, sf_dir)
    checked = request_ops.validate_requests(request_log(spark, sf_dir))
    return score_requests(request_ops.valid_requests(checked), model, "1.0.0")


def q_streamed_scores(spark, sf_dir):
    model, _ = default_fit(spark, sf_dir)
    folder = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    request_log(spark, sf_dir).write.json(f"{folder}/in")
    start_scoring(
        spark, f"{folder}/in", model, f"{folder}/out", f"{folder}/progress", "1.0.0"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON per hourly row; sites 2 to 6 break one rule each."""
    site, hour = F.col("site_id"), F.hour("hour")
    return hourly(spark, sf_dir).select(
        F.concat(
            F.lit('{"site_id": '),
            F.when(site == 2, F.lit('"two"')).otherwise(site.cast("string")),
            F.date_format("hour", "', \"timestamp\": \"'yyyy-MM-dd'T'HH:mm:ss'Z\"'"),
            F.lit(', "hour_of_day": '),
            F.when(site == 6, (hour + 24).cast("string")).otherwise(hour.cast("string")),
            F.when(site == 3, F.lit(".5")).otherwise(F.lit("")),
            F.lit(', "day_of_week": '),
            F.weekday("hour").cast("string"),
            F.lit(', "is_weekend": 0, "hour_sin": 0, "hour_cos": 1'),
            F.when(site == 4, F.lit(', "lag_1": "many"')).otherwise(F.lit("")),
            F.when(site == 5, F.lit("")).otherwise(F.lit("}")),
        ).alias("value")
    )


def q_answered_requests(spark, sf_dir):
    """One stream over good and bad requests: answered ones by site and time, refused ones whole."""
    model, _ = default_fit(spark, sf_dir)
    folder = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    request_lines(spark, sf_dir).write.text(f"{folder}/in")
    places = (f"{folder}/{name}" for name in ("answers", "refused", "progress"))
    start_answering(spark, f"{folder}/in", model, *places, "1.0.0").awaitTermination()
    answers = spark.read.parquet(f"{folder}/answers").select("site_id", "timestamp")
    refused = spark.read.parquet(f"{folder}/refused")
    return answers.unionByName(
        refused.select("raw", F.concat_ws("; ", "rules").alias("rules")), allowMissingColumns=True
    )


# What SQL can tell about the results of the fitted models: rows, keys, actual values, sizes, orders.


def q_prediction_rows(spark, sf_dir):
    model, test = default_fit(spark, sf_dir)
    scored = forecast.actual_and_predicted(model, test, keep=("site_id", "hour"))
    number = (F.col("predicted").isNotNull() & ~F.isnan("predicted")).alias("is_scored")
    return rounded(scored.select("site_id", "hour", "actual", number))


def q_comparison_actuals(spark, sf_dir):
    series = forecast.comparison_series(*default_fit(spark, sf_dir))
    return rounded(series.filter("series = 'actual'").drop("series"))


def q_importance_names(spark, sf_dir):
    found = forecast.feature_importance(default_fit(spark, sf_dir)[0])
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share"))


def q_fold_scores(spark, sf_dir):
    rows, names = split_rows(spark, sf_dir)
    train = training.indexed_training_part(rows)
    scores = forecast.cross_validate(train, names)
    sizes = split.fold_summary(train).select("fold", "train_rows", "test_rows")
    return scores.join(sizes, "fold").select("fold", "train_rows", "test_rows", (F.col("mae") > 0).alias("has_error"))


def q_tuning_points(spark, sf_dir):
    points = q_parameter_tuning(spark, sf_dir)
    least = points.agg(F.min("mean_mae")).first()[0]
    right = (F.col("mean_mae") == least) | ~F.col("is_best")
    return points.select("max_depth", "learning_rate", "n_estimators", right.alias("is_consistent"))


def q_training_result_rows(spark, sf_dir):
    found = q_training_results(spark, sf_dir)
    size = F.when(F.col("name") == "sample_size", F.col("value").cast("long"))
    return found.select("section", "name", F.col("value").isNotNull().alias("has_value"), size.alias("size"))


def q_baseline_scores(spark, sf_dir):
    found = q_baseline_model(spark, sf_dir)
    return found.select("sample_size", (F.col("mae") <= F.col("rmse")).alias("is_ordered"))


def _score_rows(scores: DataFrame) -> DataFrame:
    band = F.col("confidence_interval")
    gaps = [
        F.abs(band[end] - F.col("prediction") * share) <= 1e-9 * F.abs(F.col("prediction"))
        for end, share in (("lower", 0.9), ("upper", 1.1))
    ]
    return scores.select("site_id", "timestamp", "model_version", (gaps[0] & gaps[1]).alias("has_band"))


def q_request_score_rows(spark, sf_dir):
    return _score_rows(q_request_scores(spark, sf_dir))


def q_streamed_score_rows(spark, sf_dir):
    return _score_rows(q_streamed_scores(spark, sf_dir))


def queries() -> dict[str, Query]:
    """Every ``q_`` function above under its plain name."""
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
