import math

import pandas as pd
import pytest

from sitepulse import defaults
from sitepulse.operators import features


def test_temporal_features(hourly):
    table = features.add_time_features(hourly)
    row = table.orderBy("hour").first()
    assert (row["hour_of_day"], row["day_of_week"], row["year"]) == (0, 0, 2024)
    assert (row["is_monday"], row["is_weekend"], row["is_holiday"]) == (1, 0, 0)
    nine = table.filter("hour_of_day = 9").first()
    assert (nine["is_business_hours"], nine["is_morning_peak"], nine["is_evening_peak"]) == (1, 1, 0)
    assert nine["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 9 / 24))
    assert nine["month_cos"] == pytest.approx(math.cos(2 * math.pi / 12))


def test_optional_groups(hourly):
    table = features.add_temporal_features(hourly, include_cyclical=False, include_calendar=False)
    assert not {"hour_sin", "month_cos", "is_holiday"} & set(table.columns)


def pandas_features(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["site_id", "hour"]).reset_index(drop=True)
    by_site = pdf.groupby("site_id")["sessions"]
    for n in defaults.LAG_PERIODS:
        pdf[f"lag_{n}"] = by_site.shift(n)
    past = by_site.shift(1)
    for n in defaults.ROLLING_WINDOWS:
        rolled = past.groupby(pdf["site_id"]).rolling(n, min_periods=1)
        for name, values in (
            ("rmean", rolled.mean()),
            ("rstd", rolled.std()),
            ("rmin", rolled.min()),
            ("rmax", rolled.max()),
        ):
            pdf[f"{name}_{n}"] = values.reset_index(0, drop=True)
    for n in defaults.DIFFERENCE_PERIODS:
        pdf[f"diff_{n}"] = by_site.diff(n)
    return pdf


def test_windows_match_brute_force(long_series):
    want = pandas_features(long_series.toPandas())
    got = (
        features.create_feature_table(long_series).toPandas()
        .sort_values(["site_id", "hour"]).reset_index(drop=True)
    )
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, atol=1e-9)


@pytest.mark.parametrize("windows", [(5,), (4, 6), (7, 30), (12, 36), (3, 301), (50, 100)])
def test_other_windows(long_series, windows):
    got = (
        features.add_rolling_features(long_series, windows=windows).toPandas()
        .sort_values(["site_id", "hour"]).reset_index(drop=True)
    )
    past = got.groupby("site_id")["sessions"].shift(1)
    for n in windows:
        rolled = past.groupby(got["site_id"]).rolling(n, min_periods=1)
        for name, want in (("rmean", rolled.mean()), ("rstd", rolled.std()), ("rmax", rolled.max())):
            want = want.reset_index(0, drop=True)
            pd.testing.assert_series_equal(got[f"{name}_{n}"], want, check_names=False, atol=1e-9)


@pytest.mark.parametrize("chunk_rows", [168, 175, 300, 5000])
def test_chunks_do_not_change_the_result(long_series, chunk_rows):
    whole = features.create_feature_table(long_series, include_interactions=True)
    cut = features.create_feature_table(
        long_series, include_interactions=True, chunk_rows=chunk_rows
    )
    assert cut.columns == whole.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_chunks_shorter_than_the_look_back_are_refused(long_series):
    with pytest.raises(ValueError, match="at least 168"):
        features.create_feature_table(long_series, chunk_rows=100)


def test_no_deviation_in_constant_runs(spark, long_series):
    flat = long_series.selectExpr("site_id", "hour", "0.1D + 0 * coalesce(sessions, 0) AS sessions")
    row = features.add_rolling_features(flat).selectExpr("max(rstd_24)", "max(rstd_168)").first()
    assert max(row) < 1e-9
    lean = features.add_rolling_features(flat, include_std=False)
    assert [c for c in lean.columns if c.startswith("rstd")] == []


def test_one_shuffle_for_all_windows(long_series):
    table = features.create_feature_table(long_series)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort") == 1


def test_interactions(hourly):
    table = features.add_interaction_features(features.add_time_features(hourly))
    assert "hour_of_day_x_is_weekend" in table.columns
    assert "lag_1_x_hour_of_day" not in table.columns
    row = table.filter("hour_of_day = 12").first()
    assert row["is_business_hours_x_day_of_week"] == row["is_business_hours"] * row["day_of_week"]


def test_names(hourly):
    names = features.model_feature_names()
    assert len(names) == 25 and set(names) <= set(features.create_feature_table(hourly).columns)
    assert not [n for n in names if n.startswith(("diff_", "month"))]
    assert features.model_feature_names((1,), (24,))[-5:] == [
        "lag_1", "rmean_24", "rstd_24", "rmin_24", "rmax_24",
    ]


def test_align(hourly):
    table = features.align_features(hourly, ["absent", "sessions"], keep=("site_id",))
    assert table.columns == ["site_id", "absent", "sessions"]
    assert table.first()["absent"] == 0.0
