"""The hourly table as a store that batches of sessions are added to.

Every batch adds its own sums, partitioned by date and batch: a load writes only the dates that it
has rows for, and loading a batch again replaces what it wrote before. Sums, counts and first
times of several batches are put together when the store is read. Dates are directories, so what
asks for days reads those days.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hourly import aggregate_hourly
from ..operators.rollups import overview_metrics

HOURS = (
    "site_id bigint, state string, hour timestamp_ntz, sessions double, session_count bigint, "
    "first_timestamp timestamp_ntz, date date, batch string"
)
SITES = "site_id bigint, batch string"


def add_batch(sessions: DataFrame, path: str, batch: str) -> None:
    """Add a batch of cleaned sessions. Each session belongs to one batch; a batch that is loaded
    again, after a failure for instance, has the same rows."""
    hourly = aggregate_hourly(sessions)
    names = [f.split()[0] for f in HOURS.split(", ")[:-2]]
    hours = hourly.select(*names, F.to_date("hour").alias("date"), F.lit(batch).alias("batch"))
    for rows, folder, parts in (
        (hours.hint("rebalance", "date"), "hours", ("date", "batch")),
        (hourly.select("site_id", F.lit(batch).alias("batch")).distinct(), "sites", ("batch",)),
    ):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*parts).parquet(f"{path}/{folder}")


def _hours(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOURS).parquet(f"{path}/hours")


def read_hourly(
    spark: SparkSession, path: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """The hourly table, of the days from ``start`` to ``end`` (both included) only, if given."""
    rows = _hours(spark, path)
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
    total = F.sum("sessions")
    count = F.sum("session_count")
    return rows.groupBy("site_id", "state", "hour").agg(
        total.alias("sessions"),
        count.alias("session_count"),
        F.try_divide(total, count).alias("avg_sessions"),
        F.min("first_timestamp").alias("first_timestamp"),
    )


def latest_date(spark: SparkSession, path: str) -> date | None:
    """The last day of the store; no column of a file is read."""
    return _hours(spark, path).agg(F.max("date")).first()[0]


def latest_hour(spark: SparkSession, path: str) -> Column:
    """The last hour of the store, from the files of its last day."""
    rows = _hours(spark, path).filter(F.col("date") == F.lit(latest_date(spark, path)))
    return rows.select(F.max("hour")).scalar()


def stored_overview(spark: SparkSession, path: str) -> DataFrame:
    """``overview_metrics`` of the store. Two days of hours are read; all sites come from the list of sites."""
    last = latest_date(spark, path)
    start = date.fromordinal(last.toordinal() - 1) if last else None
    recent = overview_metrics(read_hourly(spark, path, start, last), latest_hour(spark, path))
    sites = spark.read.schema(SITES).parquet(f"{path}/sites").select(F.count_distinct("site_id"))
    return recent.withColumn("active_sites", sites.scalar())
