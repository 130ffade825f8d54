"""Scoring of prediction requests; the same plan serves batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import defaults
from ..operators.requests import request_features
from .model import PREDICTION, BoostedModel, feature_names


def prediction_interval(prediction: Column, margin: float = defaults.INTERVAL_MARGIN) -> Column:
    """A fixed band around the prediction. It is not a statistical interval."""
    return F.struct(
        (prediction * (1 - margin)).alias("lower"), (prediction * (1 + margin)).alias("upper")
    )


def score_requests(
    requests: DataFrame,
    model: BoostedModel,
    model_version: str = "unknown",
    observation: Observation | None = None,
) -> DataFrame:
    """``prediction, site_id, timestamp, model_version, confidence_interval`` per valid request.

    The number of scored rows is counted along the way when ``observation`` is given. A sort right
    after this step would sample, and so count, the rows twice.
    """
    if model is None:
        raise RuntimeError("Model not loaded")
    scored = model.transform(
        request_features(requests, feature_names(model), keep=("site_id", "timestamp"))
    )
    result = scored.select(
        PREDICTION,
        "site_id",
        "timestamp",
        F.lit(model_version).alias("model_version"),
        prediction_interval(F.col(PREDICTION)).alias("confidence_interval"),
    )
    if observation is not None:
        result = result.observe(observation, F.count(F.lit(1)).alias("scored"))
    return result
