"""From the session log to a trained and evaluated model."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions.metrics import METRICS
from ..operators import split
from ..operators.features import (
    add_lag_features,
    add_rolling_features,
    add_temporal_features,
    create_feature_table,
    model_feature_names,
)
from ..operators.hourly import aggregate_hourly
from ..operators.quality import drop_incomplete
from ..session import materialize
from ..sources.reports import RESULT_SCHEMA, save_named_model, save_training_results
from . import model as forecast
from .model import BoostedModel

log = logging.getLogger(__name__)

MODEL_NAME = "gbt"


def training_rows(sessions: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Complete rows of the feature table; the lags cost each site its first rows."""
    return drop_incomplete(create_feature_table(aggregate_hourly(sessions), chunk_rows=chunk_rows))


def available_features(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    """The model features that ``df`` has; missing ones are logged."""
    names = list(names or model_feature_names())
    missing = [n for n in names if n not in df.columns]
    if missing:
        log.warning("Missing features: %s", missing)
    return [n for n in names if n in df.columns]


def prepare_data(
    sessions: DataFrame,
    test_size: float = defaults.TEST_SIZE,
    validation_size: float = defaults.VALIDATION_SIZE,
    time_based_split: bool = True,
    chunk_rows: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Training rows with their ``split`` and the names of the model features."""
    rows = training_rows(sessions, chunk_rows)
    names = available_features(rows)
    rows = materialize(rows.select("site_id", "hour", forecast.LABEL, *names), "rows")
    divide = split.time_split if time_based_split else split.random_split
    # bins, fits and scores each read parts of it
    return materialize(divide(rows, test_size, validation_size), "split"), names


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)


def indexed_training_part(rows: DataFrame) -> DataFrame:
    """Training rows, indexed for the folds by their place in the training part itself."""
    train = _part(rows, "train")
    size = F.lit(train.count())
    return train.withColumn(split.TOTAL, size)


def _metric_rows(section: str, metrics: DataFrame) -> DataFrame:
    names = [*METRICS, "sample_size"]
    wide = metrics.select(*[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "name", "value").select(
        F.lit(section).alias("section"), "name", "value", F.lit(None).cast("string").alias("detail")
    )


def _score_rows(section: str, scores: DataFrame) -> DataFrame:
    """The error of each fold, their mean and their deviation."""
    folds = scores.select(F.format_string("fold_%d", "fold").alias("name"), F.col("mae").alias("value"))
    both = forecast.score_summary(scores).select("mean_score", "std_score")
    return folds.union(both.unpivot([], both.columns, "name", "value")).select(
        F.lit(section).alias("section"), "name", "value", F.lit(None).cast("string").alias("detail")
    )


def train_model(
    rows: DataFrame,
    names: list[str],
    tuning: bool = False,
    cross_validation: bool = True,
    grid: Mapping[str, Iterable[Any]] = defaults.TUNING_GRID,
    cv_splits: int = defaults.CV_SPLITS,
    tuning_splits: int = defaults.TUNING_SPLITS,
    **params: Any,
) -> tuple[BoostedModel, list[DataFrame]]:
    """Fit with early stopping, or tune; then cross-validate. Returns the model and result rows."""
    results = []
    train = indexed_training_part(rows)
    if tuning:
        model, best, scores = forecast.tune(train, names, grid, tuning_splits, **params)
        params = {**params, **best}
        described = F.to_json(F.struct("max_depth", "learning_rate", "n_estimators"))
        results.append(
            scores.select(
                F.lit("tuning").alias("section"),
                F.when(F.col("is_best"), "best").otherwise("candidate").alias("name"),
                F.col("mean_mae").alias("value"),
                described.alias("detail"),
            )
        )
    else:
        model = forecast.fit(train, names, _part(rows, "validation"), **params)
    if cross_validation:
        folds = forecast.cross_validate(train, names, cv_splits, **params)
        results.append(_score_rows("cross_validation", folds))
    return model, results


def run_training(
    sessions: DataFrame,
    output_dir: str | None = None,
    tuning: bool = False,
    now: datetime | None = None,
    chunk_rows: int | None = None,
    **options: Any,
) -> tuple[BoostedModel, DataFrame]:
    """Prepare, train, cross-validate and test; with ``output_dir`` also save all of it.

    The model is saved under a time-stamped path and under its plain name; the paths are
    the ``artifact`` rows of the returned results.
    """
    rows, names = prepare_data(sessions, chunk_rows=chunk_rows)
    model, parts = train_model(rows, names, tuning=tuning, **options)
    parts.append(_metric_rows("test", forecast.evaluate(model, _part(rows, "test"))))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    if output_dir is not None:
        models = {MODEL_NAME: model}
        paths = {
            "model_path": save_named_model(models, MODEL_NAME, output_dir, True, now),
            "current_model_path": save_named_model(models, MODEL_NAME, output_dir, False),
            "results_path": save_training_results(results, output_dir),
        }
        rows = [("artifact", name, None, path) for name, path in paths.items()]
        results = results.unionByName(results.sparkSession.createDataFrame(rows, RESULT_SCHEMA))
    return model, results


def baseline_rows(sessions: DataFrame) -> DataFrame:
    """Complete rows with the small feature set of the baseline model."""
    table = (
        aggregate_hourly(sessions)
        .transform(add_temporal_features)
        .transform(add_lag_features)
        .transform(add_rolling_features, windows=(24,))
    )
    return drop_incomplete(table)


def baseline_fit(
    sessions: DataFrame, n_estimators: int = defaults.BASELINE_ESTIMATORS, **params: Any
) -> tuple[BoostedModel, DataFrame]:
    """The baseline model on the first 90 % of rows, and its metrics on the rest."""
    names = list(defaults.BASELINE_FEATURES)
    rows = baseline_rows(sessions).select("site_id", "hour", forecast.LABEL, *names)
    parts = materialize(split.baseline_split(materialize(rows, "rows")), "split")
    model = forecast.fit(_part(parts, "train"), names, n_estimators=n_estimators, **params)
    return model, forecast.evaluate(model, _part(parts, "test"))
