"""Dashboard rollups over the hourly (or feature) table.

Every function needs only ``site_id``, ``state``, ``hour`` and ``sessions``. Latest-hour and
latest-date values are scalar subqueries, so no join is needed to compare rows with them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults

# Column order of the weekday matrix.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _on_day(day: Column) -> Column:
    """Rows whose hour falls on ``day``, as a plain range that a scan can use."""
    start = day.cast("timestamp_ntz")
    hour = F.col("hour")
    return (hour >= start) & (hour < start + F.expr("INTERVAL 1 DAY"))


def _latest_date(hourly: DataFrame, latest_hour: Column | None) -> Column:
    """The date of ``latest_hour`` if the caller knows it; otherwise ``hourly`` is evaluated for it."""
    return hourly.select(F.to_date(F.max("hour"))).scalar() if latest_hour is None else F.to_date(latest_hour)


def select_sites(
    hourly: DataFrame, sites: list[int] | None = None, n: int = defaults.COMPARED_SITES
) -> DataFrame:
    """Rows of the chosen sites; without a choice, of the ``n`` smallest site ids."""
    if sites is not None:
        return hourly.filter(F.col("site_id").isin(list(sites)))
    chosen = hourly.select("site_id").distinct().orderBy("site_id").limit(n)
    return hourly.join(F.broadcast(chosen), "site_id", "left_semi")


def select_dates(hourly: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included, as a range on ``hour`` itself."""
    hour = F.col("hour")
    if start is not None:
        hourly = hourly.filter(hour >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        hourly = hourly.filter(hour < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    return hourly


def site_comparison(hourly: DataFrame, sites: list[int] | None = None) -> DataFrame:
    """The demand series of a few sites."""
    return select_sites(hourly, sites).select("site_id", "hour", "sessions")


def state_rollup(hourly: DataFrame) -> DataFrame:
    """Sites, mean and peak per state, the quietest state first.

    Aggregates per site and state first: a state with a third of all rows is then reduced to
    its sites before the distinct count.
    """
    per_site = hourly.groupBy("state", "site_id").agg(
        F.sum("sessions").alias("_sum"),
        F.count("sessions").alias("_n"),
        F.max("sessions").alias("_max"),
    )
    return (
        per_site.groupBy("state")
        .agg(
            F.count("site_id").alias("total_stations"),
            F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_sessions"),
            F.max("_max").alias("peak_sessions"),
        )
        .orderBy("mean_sessions")
    )


def state_hour_profile(hourly: DataFrame) -> DataFrame:
    """Mean demand as a matrix of state and hour of day (``h00`` to ``h23``)."""
    hours = list(range(24))
    matrix = (
        hourly.withColumn("_hour", F.hour("hour"))
        .groupBy("state")
        .pivot("_hour", hours)
        .agg(F.avg("sessions"))
    )
    return matrix.select("state", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in hours])


def daily_by_state(
    hourly: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Demand per date and state within a date range (all dates by default)."""
    return (
        select_dates(hourly, start, end)
        .groupBy(F.to_date("hour").alias("date"), "state")
        .agg(F.coalesce(F.sum("sessions"), F.lit(0.0)).alias("sessions"))
    )


def daily_total(hourly: DataFrame) -> DataFrame:
    """Demand per date over all sites."""
    return hourly.groupBy(F.to_date("hour").alias("date")).agg(
        F.coalesce(F.sum("sessions"), F.lit(0.0)).alias("total_sessions")
    )


def demand_heatmap(hourly: DataFrame) -> DataFrame:
    """Mean demand as a matrix of hour of day and weekday (``Mon`` to ``Sun``)."""
    matrix = (
        hourly.select(
            F.hour("hour").alias("hour_of_day"), F.weekday("hour").alias("_day"), "sessions"
        )
        .groupBy("hour_of_day")
        .pivot("_day", list(range(7)))
        .agg(F.avg("sessions"))
    )
    return matrix.select(
        "hour_of_day", *[F.col(f"`{i}`").alias(name) for i, name in enumerate(WEEKDAYS)]
    )


def peak_hours(hourly: DataFrame, n: int = defaults.PEAK_HOURS) -> DataFrame:
    """The ``n`` hours of day with the highest mean; equal means in order of the hour."""
    return (
        hourly.groupBy(F.hour("hour").alias("hour_of_day"))
        .agg(F.avg("sessions").alias("mean_sessions"))
        .orderBy(F.desc_nulls_last("mean_sessions"), "hour_of_day")
        .limit(n)
    )


def weekend_weekday(hourly: DataFrame) -> DataFrame:
    """Mean on weekends and weekdays and the busier of the two (weekdays if equal)."""
    weekend = F.weekday("hour") >= 5
    means = hourly.agg(
        F.avg(F.when(~weekend, F.col("sessions"))).alias("weekday_avg"),
        F.avg(F.when(weekend, F.col("sessions"))).alias("weekend_avg"),
    )
    busier = F.when(F.col("weekend_avg") > F.col("weekday_avg"), "weekends").otherwise("weekdays")
    return means.withColumn("busier", busier)


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent to one decimal; NULL when there is no previous value or it is 0."""
    return F.round((F.try_divide(current, previous) - 1) * 100, 1)


def new_sites(hourly: DataFrame, latest_hour: Column | None = None) -> DataFrame:
    """How many sites have rows on the latest date and none on the day before."""
    latest = _latest_date(hourly, latest_hour)
    recent = hourly.filter(_on_day(latest) | _on_day(F.date_sub(latest, 1)))
    return (
        recent.groupBy("site_id")
        .agg(
            F.bool_or(_on_day(latest)).alias("_today"),
            F.bool_or(_on_day(F.date_sub(latest, 1))).alias("_before"),
        )
        .agg(F.count_if(F.col("_today") & ~F.col("_before")).alias("new_sites"))
    )


def overview_metrics(hourly: DataFrame, latest_hour: Column | None = None) -> DataFrame:
    """One row comparing the latest date with the day before.

    One pass over the hourly table makes a row per site and one per hour of the day.
    """
    latest = _latest_date(hourly, latest_hour)
    today, before = _on_day(latest), _on_day(F.date_sub(latest, 1))
    value = F.col("sessions")
    parts = (
        hourly.select("site_id", F.hour("hour").alias("_hour"), today.alias("_t"), before.alias("_b"), value)
        .groupingSets([["site_id"], ["_hour"]], "site_id", "_hour")
        .agg(
            (F.grouping("site_id") == 0).alias("_site"),
            F.bool_or("_t").alias("_today"),
            F.bool_or("_b").alias("_before"),
            F.sum(F.when(F.col("_t"), value)).alias("_sum_today"),
            F.count(F.when(F.col("_t"), value)).alias("_n_today"),
            F.sum(F.when(F.col("_b"), value)).alias("_sum_before"),
            F.count(F.when(F.col("_b"), value)).alias("_n_before"),
        )
    )

    def of_sites(name: str) -> Column:
        return F.sum(F.when(F.col("_site"), F.col(name)))

    # The largest sum wins; among equal sums the smallest hour does.
    hour_sum = F.when(
        ~F.col("_site") & F.col("_today"), F.struct("_sum_today", (-F.col("_hour")).alias("_neg"))
    )
    totals = parts.agg(
        F.count("site_id").alias("active_sites"),
        F.count_if(F.col("_site") & F.col("_today") & ~F.col("_before")).alias("new_sites"),
        F.max(hour_sum).alias("_peak"),
        F.coalesce(of_sites("_sum_today"), F.lit(0.0)).alias("_today"),
        F.coalesce(of_sites("_sum_before"), F.lit(0.0)).alias("_before"),
        F.try_divide(of_sites("_sum_today"), of_sites("_n_today")).alias("_mean_today"),
        F.try_divide(of_sites("_sum_before"), of_sites("_n_before")).alias("_mean_before"),
    )
    return totals.select(
        "active_sites",
        "new_sites",
        F.floor("_today").cast("bigint").alias("sessions_today"),
        pct_change(F.col("_today"), F.col("_before")).alias("sessions_change_pct"),
        F.col("_peak._sum_today").alias("peak_sessions"),
        (-F.col("_peak._neg")).alias("peak_hour"),
        (F.col("_mean_today") * 100).alias("mean_sessions_x100"),
        pct_change(F.col("_mean_today"), F.col("_mean_before")).alias("mean_change_pct"),
    )


def temporal_patterns(hourly: DataFrame) -> DataFrame:
    """Mean demand by hour of day, day of month, month and weekday, from one pass."""
    parts = {
        "hour_of_day": F.hour("hour"),
        "day_of_month": F.dayofmonth("hour"),
        "month": F.month("hour"),
        "day_of_week": F.weekday("hour"),
    }
    names = list(parts)
    pattern = F.lit(None).cast("string")
    for name in names:
        pattern = F.when(F.grouping(name) == 0, name).otherwise(pattern)
    return (
        hourly.select(*[c.alias(n) for n, c in parts.items()], "sessions")
        .groupingSets([[n] for n in names], *names)
        .agg(pattern.alias("pattern"), F.avg("sessions").alias("mean_sessions"))
        .select("pattern", F.coalesce(*names).alias("bucket"), "mean_sessions")
    )


def state_metrics(hourly: DataFrame) -> DataFrame:
    """One row: states, sites, mean demand at the latest hour and mean of the daily means.

    One pass over the hourly table makes a row per state and site, one per date and one per hour.
    """
    value = F.col("sessions")
    date, hour = F.to_date("hour").alias("_date"), F.col("hour").alias("_hour")
    parts = (
        hourly.select("state", "site_id", date, hour, value)
        .groupingSets([["state", "site_id"], ["_date"], ["_hour"]], "state", "site_id", "_date", "_hour")
        .agg(
            F.avg(value).alias("_mean"),
            (F.grouping("_date") == 0).alias("_is_date"),
            (F.grouping("_hour") == 0).alias("_is_hour"),
        )
    )
    # a row per state and site, date or hour is left
    newest = F.max(F.when(F.col("_is_hour"), F.struct("_hour", "_mean")))
    return parts.agg(
        F.countDistinct("state").alias("total_states"),
        F.countDistinct("site_id").alias("active_stations"),
        newest.alias("_newest"),
        F.avg(F.when(F.col("_is_date"), F.col("_mean"))).alias("avg_daily_sessions"),
    ).select(
        "total_states",
        "active_stations",
        F.col("_newest._hour").alias("latest_hour"),
        F.col("_newest._mean").alias("sessions_at_latest_hour"),
        "avg_daily_sessions",
    )


def site_tail(hourly: DataFrame, rows: int = defaults.TAIL_ROWS) -> DataFrame:
    """The last ``rows`` rows of every site. The rank filter also runs before the shuffle."""
    newest = Window.partitionBy("site_id").orderBy(F.desc("hour"))
    return (
        hourly.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= rows)
        .drop("_age")
    )
