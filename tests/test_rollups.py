from datetime import date, datetime, timedelta

import pytest

from sitepulse.operators import rollups

SCHEMA = "site_id bigint, state string, hour timestamp_ntz, sessions double"


@pytest.fixture(scope="module")
def two_days(spark):
    monday = datetime(2024, 1, 8)
    sunday = monday - timedelta(days=1)
    rows = [
        (1, "A", sunday + timedelta(hours=3), 4.0),
        (1, "A", monday + timedelta(hours=3), 6.0),
        (2, "A", monday + timedelta(hours=5), 6.0),
        (3, "B", monday + timedelta(hours=5), None),
        (4, "B", sunday - timedelta(days=3), 1.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_state_rollup(two_days):
    got = [tuple(r) for r in rollups.state_rollup(two_days).collect()]
    assert got == [("B", 2, 1.0, 1.0), ("A", 2, pytest.approx(16 / 3), 6.0)]


def test_overview(two_days):
    row = rollups.overview_metrics(two_days).first()
    assert (row["active_sites"], row["new_sites"], row["sessions_today"]) == (4, 2, 12)
    assert row["sessions_change_pct"] == 200.0
    assert (row["peak_sessions"], row["peak_hour"]) == (6.0, 3)
    assert row["mean_sessions_x100"] == 600.0 and row["mean_change_pct"] == 50.0
    assert rollups.new_sites(two_days).first()[0] == 2


def test_overview_without_a_previous_day(two_days):
    row = rollups.overview_metrics(two_days.filter("site_id = 2")).first()
    assert row["sessions_change_pct"] is None and row["mean_change_pct"] is None


def test_dates_are_inclusive(two_days):
    got = rollups.daily_by_state(two_days, date(2024, 1, 7), date(2024, 1, 8)).collect()
    assert {(str(r[0]), r[1]): r[2] for r in got} == {
        ("2024-01-07", "A"): 4.0,
        ("2024-01-08", "A"): 12.0,
        ("2024-01-08", "B"): 0.0,
    }


def test_date_filter_reaches_the_scan(spark, two_days, tmp_path):
    path = str(tmp_path / "hourly")
    two_days.write.parquet(path)
    df = rollups.daily_by_state(spark.read.parquet(path), date(2024, 1, 7), date(2024, 1, 8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour" in plan and "LessThan(hour" in plan


def test_weekend_tie_goes_to_weekdays(spark):
    rows = [(1, "A", datetime(2024, 1, 6), 2.0), (1, "A", datetime(2024, 1, 8), 2.0)]
    assert rollups.weekend_weekday(spark.createDataFrame(rows, SCHEMA)).first()["busier"] == "weekdays"


def test_sites_and_tail(long_series):
    assert {r[0] for r in rollups.select_sites(long_series, n=2).select("site_id").collect()} == {1, 2}
    assert rollups.select_sites(long_series, [21]).count() == 90
    tail = rollups.site_tail(long_series).groupBy("site_id").count().collect()
    assert {r[0]: r[1] for r in tail} == {1: 168, 2: 168, 21: 90}


def test_patterns_and_matrices(two_days):
    patterns = {(r[0], r[1]): r[2] for r in rollups.temporal_patterns(two_days).collect()}
    assert patterns[("hour_of_day", 3)] == 5.0 and patterns[("day_of_week", 6)] == 4.0
    assert len({k[0] for k in patterns}) == 4
    heat = {r["hour_of_day"]: r for r in rollups.demand_heatmap(two_days).collect()}
    assert heat[3]["Sun"] == 4.0 and heat[3]["Mon"] == 6.0 and heat[3]["Tue"] is None
    profile = {r["state"]: r for r in rollups.state_hour_profile(two_days).collect()}
    assert profile["A"]["h03"] == 5.0 and profile["B"]["h05"] is None


def test_peak_hours(two_days):
    got = [tuple(r) for r in rollups.peak_hours(two_days, 2).collect()]
    assert got == [(5, 6.0), (3, 5.0)]


def test_state_metrics(two_days):
    row = rollups.state_metrics(two_days).first()
    assert (row["total_states"], row["active_stations"]) == (2, 4)
    assert row["sessions_at_latest_hour"] == 6.0
    assert row["avg_daily_sessions"] == pytest.approx((4 + 6 + 1) / 3)
