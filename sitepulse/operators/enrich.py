"""Lookups in the site dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import UNKNOWN_STATE, site_coordinates, site_states

# Status labels and their colours.
ACTIVE, INACTIVE, UNKNOWN_STATUS = "Active", "Inactive", "Unknown"
STATUS_COLOURS = {ACTIVE: "#2ecc71", INACTIVE: "#e74c3c", UNKNOWN_STATUS: "#95a5a6"}


def add_state(df: DataFrame) -> DataFrame:
    """Look up ``state`` by ``site_id``; sites outside the dimension become ``Unknown``."""
    states = F.broadcast(site_states(df.sparkSession))
    joined = df.drop("state").join(states, "site_id", "left")
    return joined.withColumn("state", F.coalesce("state", F.lit(UNKNOWN_STATE)))


def unmapped_sites(df: DataFrame) -> DataFrame:
    """The distinct site ids that have no state."""
    states = F.broadcast(site_states(df.sparkSession))
    return df.select("site_id").join(states, "site_id", "left_anti").distinct()


def station_status(hourly: DataFrame, latest_hour: Column | None = None) -> DataFrame:
    """Each known site with its demand at the latest hour, a status and a colour.

    The latest rows are cut down to the known sites before the outer join, so at most one row
    per dimension row is left on that side however many sites report. ``latest_hour`` saves
    looking it up in ``hourly``, which evaluates that a second time.
    """
    places = site_coordinates(hourly.sparkSession)
    if latest_hour is None:
        latest_hour = hourly.select(F.max("hour")).scalar()
    latest = (
        hourly.filter(F.col("hour") == latest_hour)
        .join(F.broadcast(places.select("site_id")), "site_id", "left_semi")
        .select("site_id", "sessions")
    )
    status = (
        F.when(latest_hour.isNull(), UNKNOWN_STATUS)
        .when(F.col("sessions") > 0, ACTIVE)
        .otherwise(INACTIVE)
    )
    colour = F.create_map(*[F.lit(x) for pair in STATUS_COLOURS.items() for x in pair])
    return (
        places.join(latest, "site_id", "left")
        .withColumn("status", status)
        .withColumn("color", colour[F.col("status")])
    )
