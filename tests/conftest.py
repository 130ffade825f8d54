from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from sitepulse.session import get_spark  # noqa: E402

START = datetime(2024, 1, 1)
SESSIONS = "site_id bigint, timestamp timestamp_ntz, sessions double"
HOURLY = (
    "site_id bigint, hour timestamp_ntz, sessions double, session_count bigint, "
    "avg_sessions double, first_timestamp timestamp_ntz"
)


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_rows():
    sites = (1, 1, 1, 2, 2, 2)
    values = (5.0, 3.2, 7.8, 4.1, 6.5, 2.9)
    return [(sites[i % 6], START + timedelta(hours=i), values[i % 6]) for i in range(60)]


@pytest.fixture(scope="session")
def raw(spark, raw_rows):
    return spark.createDataFrame(raw_rows, SESSIONS)


@pytest.fixture(scope="session")
def hourly(spark):
    sites, values = (1, 1, 2, 2), (5.0, 3.2, 7.8, 4.1)
    rows = []
    for i in range(48):
        hour, value = START + timedelta(hours=i), values[i % 4]
        rows.append((sites[i % 4], hour, value, 1, value, hour))
    return spark.createDataFrame(rows, HOURLY)


@pytest.fixture(scope="session")
def long_series(spark):
    """Three sites with gaps, nulls and ties; an hourly table with states."""
    import random

    random.seed(7)
    rows = []
    for site, length in ((1, 400), (2, 260), (21, 90)):
        hour = START
        for _ in range(length):
            hour += timedelta(hours=random.choice((1, 1, 1, 2, 5)))
            value = None if random.random() < 0.05 else float(random.randint(0, 30))
            rows.append((site, "Delhi" if site < 3 else "Unknown", hour, value))
    return spark.createDataFrame(
        rows, "site_id bigint, state string, hour timestamp_ntz, sessions double"
    )
