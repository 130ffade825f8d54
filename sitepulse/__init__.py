"""Site-level demand analytics and forecasting on Spark DataFrames."""

from .operators.features import (
    add_difference_features,
    add_interaction_features,
    add_lag_features,
    add_rolling_features,
    add_temporal_features,
    add_time_features,
    create_feature_table,
    model_feature_names,
)
from .operators.hourly import aggregate_hourly, data_summary
from .operators.quality import DataValidationError, clean_data, validate_data
from .session import get_spark
from .sources.sessions import load_sessions

__all__ = [
    "DataValidationError",
    "add_difference_features",
    "add_interaction_features",
    "add_lag_features",
    "add_rolling_features",
    "add_temporal_features",
    "add_time_features",
    "aggregate_hourly",
    "clean_data",
    "create_feature_table",
    "data_summary",
    "get_spark",
    "load_sessions",
    "model_feature_names",
    "validate_data",
]
