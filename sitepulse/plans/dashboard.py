"""The data behind the dashboard pages, each table a lazy plan over one stored feature table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from ..operators import enrich, profile, rollups
from ..operators.features import create_feature_table
from ..operators.hourly import aggregate_hourly
from ..session import materialize

DISTRIBUTION_COLUMNS = ["hour_of_day", "day_of_week", "is_weekend"]


def dashboard_table(sessions: DataFrame) -> DataFrame:
    """Clean sessions to the feature table, written once so that the pages read columns of it."""
    return materialize(create_feature_table(aggregate_hourly(sessions)), "dashboard")


def overview_page(table: DataFrame) -> dict[str, DataFrame]:
    return {
        "metrics": rollups.overview_metrics(table),
        "daily_total": rollups.daily_total(table),
        "demand_heatmap": rollups.demand_heatmap(table),
        "peak_hours": rollups.peak_hours(table),
        "weekend_weekday": rollups.weekend_weekday(table),
    }


def site_page(table: DataFrame, sites: list[int] | None = None) -> dict[str, DataFrame]:
    return {
        "comparison": rollups.site_comparison(table, sites),
        "last_week": rollups.site_tail(rollups.select_sites(table, sites)),
    }


def state_page(
    table: DataFrame, start: date | None = None, end: date | None = None
) -> dict[str, DataFrame]:
    return {
        "metrics": rollups.state_metrics(table),
        "states": rollups.state_rollup(table),
        "stations": enrich.station_status(table),
        "hour_profile": rollups.state_hour_profile(table),
        "daily": rollups.daily_by_state(table, start, end),
    }


def feature_page(
    table: DataFrame,
    families: tuple[str, ...] = profile.DEFAULT_FAMILIES,
    distributions: list[str] | None = None,
) -> dict[str, DataFrame]:
    columns = distributions or DISTRIBUTION_COLUMNS
    return {
        "correlation": profile.correlation_with_target(table),
        "correlation_matrix": profile.correlation_matrix(
            table, profile.family_columns(table, families)
        ),
        "temporal_patterns": rollups.temporal_patterns(table),
        "histogram": profile.histogram(table, columns),
        "box_stats": profile.box_stats(table, columns),
    }
