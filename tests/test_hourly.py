from datetime import datetime, timedelta

import pytest
from conftest import SESSIONS, START

from sitepulse.operators import enrich
from sitepulse.operators.hourly import aggregate_hourly, data_summary, latest_hour
from sitepulse.operators.quality import DataValidationError


def test_columns_and_values(spark):
    rows = [
        (1, datetime(2024, 1, 1, 5, 10), 2.0),
        (1, datetime(2024, 1, 1, 5, 0), 4.0),
        (1, datetime(2024, 1, 1, 5, 59, 59, 999999), None),
        (25, datetime(2024, 1, 1, 6), None),
        (None, datetime(2024, 1, 1, 6), 1.0),
        (1, None, 1.0),
    ]
    got = aggregate_hourly(spark.createDataFrame(rows, SESSIONS)).orderBy("site_id").collect()
    assert [tuple(r) for r in got] == [
        (1, "Delhi", datetime(2024, 1, 1, 5), 6.0, 2, 3.0, datetime(2024, 1, 1, 5)),
        (25, "Unknown", datetime(2024, 1, 1, 6), 0.0, 0, None, datetime(2024, 1, 1, 6)),
    ]


def test_text_timestamps_and_given_state(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01T05:30:00", 2.0, "Mine")],
        "site_id int, timestamp string, sessions double, state string",
    )
    row = aggregate_hourly(df).first()
    assert (row["state"], row["hour"]) == ("Mine", datetime(2024, 1, 1, 5))


def test_hours_do_not_depend_on_the_session_time_zone(spark, raw):
    want = sorted(map(tuple, aggregate_hourly(raw).collect()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(1, datetime(2024, 3, 10, 2, 30), 1.0)]  # an hour that zone skips
        assert aggregate_hourly(spark.createDataFrame(rows, SESSIONS)).first()["hour"].hour == 2
        assert sorted(map(tuple, aggregate_hourly(raw).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_missing_column(spark):
    with pytest.raises(DataValidationError):
        aggregate_hourly(spark.createDataFrame([(1,)], "site_id int"))


def test_summary(spark, raw, hourly):
    got = data_summary(raw).first()
    assert (got["total_rows"], got["unique_sites"], got["start"]) == (60, 2, START)
    assert got["median"] == pytest.approx(4.55) and got["max"] == 7.8
    assert got["null_sessions"] == 0
    assert data_summary(raw, approximate_median=True).first()["median"] in (4.1, 5.0)
    assert data_summary(hourly).first()["start"] == START


def test_unmapped_sites(spark):
    df = spark.createDataFrame([(1,), (21,), (21,), (30,)], "site_id bigint")
    assert sorted(r[0] for r in enrich.unmapped_sites(df).collect()) == [21, 30]


def test_station_status(spark):
    hour = datetime(2024, 1, 2)
    rows = [(1, hour, 3.0), (2, hour, 0.0), (3, START, 9.0), (77, hour, 4.0)]
    df = spark.createDataFrame(rows, "site_id bigint, hour timestamp_ntz, sessions double")
    got = {r["site_id"]: r for r in enrich.station_status(df).collect()}
    assert len(got) == 20 and 77 not in got
    assert [got[i]["status"] for i in (1, 2, 3)] == ["Active", "Inactive", "Inactive"]
    assert got[1]["color"] == "#2ecc71" and got[2]["color"] == "#e74c3c"
    empty = enrich.station_status(df.filter("site_id < 0")).collect()
    assert {(r["status"], r["color"]) for r in empty} == {("Unknown", "#95a5a6")}


def test_date_filters_reach_the_scan(spark, tmp_path, raw, raw_rows):
    from datetime import date

    path = str(tmp_path / "log")
    raw.write.parquet(path)
    log = spark.read.parquet(path)
    got = aggregate_hourly(log, date(2024, 1, 2), date(2024, 1, 2), sites=[1])
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed and "site_id" in pushed
    assert got.count() == len([r for r in raw_rows if r[0] == 1 and r[1].day == 2])


def test_nan_counts_as_missing(spark):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1), v) for v in (2.0, float("nan"))]
    df = spark.createDataFrame(rows, "site_id bigint, timestamp timestamp_ntz, sessions double")
    hour = aggregate_hourly(df).first()
    assert hour["sessions"] == 2.0 and hour["session_count"] == 1 and hour["avg_sessions"] == 2.0
    summary = data_summary(df).first()
    assert summary["max"] == 2.0 and summary["null_sessions"] == 1 and summary["median"] == 2.0


def test_latest_hour_of_the_log(spark):
    """The last row has no site, so the hourly table does not hold it either."""
    start = datetime(2024, 1, 1)
    rows = [(1, start, 1.0), (2, start + timedelta(hours=5, minutes=40), 2.0), (None, start + timedelta(days=9), 3.0)]
    log = spark.createDataFrame(rows, "site_id bigint, timestamp timestamp_ntz, sessions double")
    latest = spark.range(1).select(latest_hour(log)).first()[0]
    assert latest == aggregate_hourly(log).agg({"hour": "max"}).first()[0] == start + timedelta(hours=5)
    assert spark.range(1).select(latest_hour(log.limit(0))).first()[0] is None
