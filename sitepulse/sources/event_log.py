"""Read a general event table as a session log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def sessions_from_events(spark: SparkSession, sf_dir: str, sites: int = 10) -> DataFrame:
    """Map ``events`` to ``site_id, timestamp, sessions`` plus ``event_id`` as the input order."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return events.select(
        (F.col("user_id") % sites + 1).alias("site_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("sessions"),
        "event_id",
    )
