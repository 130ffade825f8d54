"""Calendar expressions over a ``timestamp_ntz`` column. None depends on the session time zone."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_hour(ts: Column) -> Column:
    """Cut a timestamp to its hour."""
    past = F.make_dt_interval(mins=F.minute(ts), secs=F.extract(F.lit("SECOND"), ts))
    return ts - past


def moment(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal. A plain datetime literal would pass through two time zones."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Date parts (Monday = 0) and 0/1 flags."""
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "is_weekend": _flag(day >= 5),
        "is_monday": _flag(day == 0),
        "is_friday": _flag(day == 4),
        "is_business_hours": _flag(hour.between(9, 17) & (day < 5)),
        "is_morning_peak": _flag(hour.between(7, 9)),
        "is_evening_peak": _flag(hour.between(17, 19)),
    }


def cyclical_columns(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the hour, the weekday and the month."""
    columns = {}
    for name, value, period in (
        ("hour", F.hour(ts), 24),
        ("day", F.weekday(ts), 7),
        ("month", F.month(ts), 12),
    ):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = _cycle(value, period)
    return columns
