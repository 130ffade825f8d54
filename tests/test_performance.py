import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepulse.functions.metrics import regression_metrics
from sitepulse.functions.significance import student_t_p_value
from sitepulse.operators import performance
from sitepulse.sources import reports

RECORD = reports.RECORD_SCHEMA
DAY = datetime(2024, 3, 1)


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 5, 80).astype(float)
    p = a + rng.normal(0, 1, 80)
    df = spark.createDataFrame(list(zip(map(float, a), map(float, p))), "actual double, predicted double")
    row = df.repartition(3).agg(*regression_metrics()).first()
    assert row["mae"] == pytest.approx(np.abs(p - a).mean())
    assert row["rmse"] == pytest.approx(math.sqrt(((p - a) ** 2).mean()))
    assert row["mape"] == pytest.approx(np.abs((a - p)[a != 0] / a[a != 0]).mean() * 100)
    assert row["r2"] == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert row["sample_size"] == 80


def test_metric_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "actual double, predicted double")
    row = df.agg(*regression_metrics()).first()
    assert row["mape"] is None and row["r2"] == 0.0
    third = spark.createDataFrame([(0.1, 0.2)] * 7, "actual double, predicted double").repartition(4)
    assert third.agg(*regression_metrics()).first()["r2"] == 0.0


def test_degraded(spark):
    records = spark.createDataFrame(
        [(DAY, 1.2, 1.05, None, 0.4, 10), (DAY + timedelta(days=1), 1.0, 1.0, 9.0, 0.9, 10)], RECORD
    )
    baseline = spark.createDataFrame(
        [("mae", 1.0), ("rmse", 1.0), ("r2", 0.8), ("other", 1.0)], "metric string, value double"
    )
    got = performance.degraded_metrics(records, baseline)
    rows = {r["metric"]: r for r in got.collect()}
    assert set(rows) == {"mae", "r2"}
    assert rows["mae"]["degradation_pct"] == pytest.approx(20)
    assert rows["r2"]["degradation_pct"] == pytest.approx(50)
    alerts = performance.performance_alerts(got, "gbt").collect()
    assert len(alerts) == 1
    assert "mae is 1.2000 and was 1.0000: worse by 20.0 percent" in alerts[0]["message"]


def t_tail(t, df):
    """Two-sided tail by numeric integration of the density."""
    x = np.linspace(0, abs(t), 200001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(y, x)


def test_student_t(spark):
    cases = [(t, df) for t in (0.0, 0.5, 2.1, 8.0) for df in (1, 2, 3, 4, 5, 8, 29, 30)]
    df = spark.createDataFrame(cases, "t double, df bigint")
    rows = df.select("t", "df", student_t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    for t, freedom, p in rows:
        assert p == pytest.approx(t_tail(t, freedom), abs=1e-8), (t, freedom)


def test_student_t_with_very_many_records(spark):
    df = spark.createDataFrame([(1.5, 100_000_000)], "t double, df bigint")
    p = df.select(student_t_p_value(F.col("t"), F.col("df"))).first()[0]
    assert p == pytest.approx(math.erfc(1.5 / math.sqrt(2)), abs=1e-6)


def records(spark, values):
    rows = [(DAY + timedelta(hours=i), float(v), 2.0, float(-v), 0.5, 3) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORD).repartition(3)


def test_trend_labels(spark):
    rng = np.random.default_rng(2)
    values = np.arange(20) + rng.normal(0, 1, 20)
    got = {r["metric"]: r for r in performance.metric_trend(records(spark, values)).collect()}
    assert got["mae"]["trend"] == "increasing" and got["mape"]["trend"] == "decreasing"
    assert got["rmse"]["trend"] == "stable" and got["rmse"]["p_value"] == 1.0
    slope, _ = np.polyfit(np.arange(20), values, 1)
    assert got["mae"]["slope"] == pytest.approx(slope)
    r = np.corrcoef(np.arange(20), values)[0, 1]
    t = r * math.sqrt(18 / (1 - r * r))
    assert got["mae"]["p_value"] == pytest.approx(t_tail(t, 18), abs=1e-8)


@pytest.mark.parametrize(
    ("values", "trend"),
    [([1], "insufficient_data"), ([1, 2], "increasing"), ([1, 1], "stable"), ([3, 2, 1], "decreasing")],
)
def test_trend_of_few_records(spark, values, trend):
    got = {r["metric"]: r["trend"] for r in performance.metric_trend(records(spark, values)).collect()}
    assert got["mae"] == trend


def test_summary_window(spark):
    history = records(spark, [9, 1, 2, 3])
    got = performance.performance_summary(history, DAY + timedelta(days=30, hours=1), 30).collect()
    row = {r["metric"]: r for r in got}["mae"]
    assert (row["num_evaluations"], row["total_predictions"]) == (3, 9)
    assert row["mean"] == 2.0 and row["std"] == pytest.approx(math.sqrt(2 / 3))
    assert performance.performance_summary(history, DAY + timedelta(days=90), 30).count() == 0


def test_history_round_trip(spark, tmp_path):
    history = records(spark, [1, 2, 3])
    baseline = spark.createDataFrame([("mae", 1.5)], "metric string, value double")
    path = str(tmp_path / "history")
    reports.save_performance_history(history.filter("mae < 2"), baseline, path, "gbt")
    reports.save_performance_history(history.filter("mae >= 2"), baseline, path, "gbt")
    back, base = reports.load_performance_history(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, history.collect()))
    assert [tuple(r) for r in base.collect()] == [("gbt", "mae", 1.5)]


def test_recent_records_do_not_depend_on_the_session_time_zone(spark):
    history = records(spark, range(10))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        recent = performance.recent_records(history, DAY + timedelta(days=30, hours=4), 30)
        assert recent.count() == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_saving_what_was_loaded_keeps_everything(spark, tmp_path):
    history = records(spark, [1, 2, 3])
    baseline = spark.createDataFrame([("mae", 1.0), ("r2", 0.5)], "metric string, value double")
    path = str(tmp_path / "history")
    with pytest.raises(FileNotFoundError):
        reports.load_performance_history(spark, path)
    reports.save_performance_history(history, baseline, path, "gbt")
    for _ in range(2):
        reports.save_performance_history(*reports.load_performance_history(spark, path), path, "gbt")
    reports.save_performance_history(history.limit(1), baseline.limit(1), path, "other")
    back, base = reports.load_performance_history(spark, path, "gbt")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, history.collect()))
    assert sorted((r.metric, r.value) for r in base.collect()) == [("mae", 1.0), ("r2", 0.5)]


def _bytes_below(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.json"))


def test_saves_at_once_keep_both_sets_of_records(spark, tmp_path, monkeypatch):
    """Both savers look at the history before either of them has written."""
    history = records(spark, [1, 2, 3, 4])
    baseline = spark.createDataFrame([("mae", 1.0)], "metric string, value double")
    path = str(tmp_path / "history")
    reports.save_performance_history(history.filter("mae = 1"), baseline, path, "gbt")
    seen = reports._commits(spark, path)
    monkeypatch.setattr(reports, "_commits", lambda *_: seen)
    for part in ("mae = 2", "mae = 3"):
        reports.save_performance_history(history.filter(part), baseline, path, "gbt")
    monkeypatch.undo()
    assert sorted(c["seq"] for c in reports._commits(spark, path)) == [1, 2, 2]
    back, base = reports.load_performance_history(spark, path)
    assert sorted(r["mae"] for r in back.collect()) == [1, 2, 3] and base.count() == 1


def test_a_later_save_wins_also_after_compaction(spark, tmp_path):
    history = records(spark, [1, 2, 3])
    path = str(tmp_path / "history")
    for round_ in range(3):
        baseline = spark.createDataFrame([("mae", float(round_))], "metric string, value double")
        changed = history.withColumn("sample_size", history.sample_size * 0 + round_)
        reports.save_performance_history(changed, baseline, path, "gbt")
        if round_:
            reports.compact_performance_history(spark, path)
            assert len(reports._commits(spark, path)) == 1
        back, base = reports.load_performance_history(spark, path, "gbt")
        assert {r["sample_size"] for r in back.collect()} == {round_} and back.count() == 3
        assert [r["value"] for r in base.collect()] == [float(round_)]


def test_a_save_does_not_rewrite_the_history(spark, tmp_path):
    baseline = spark.createDataFrame([("mae", 1.0)], "metric string, value double")
    folder = tmp_path / "history"
    reports.save_performance_history(records(spark, range(1, 400)), baseline, str(folder), "gbt")
    before = _bytes_below(folder)
    reports.save_performance_history(records(spark, [500]), baseline, str(folder), "other")
    assert _bytes_below(folder) - before < before / 20


def test_a_save_that_failed_is_not_seen(spark, tmp_path):
    history = records(spark, [1, 2])
    baseline = spark.createDataFrame([("mae", 1.0)], "metric string, value double")
    path = str(tmp_path / "history")
    reports.save_performance_history(history.limit(1), baseline, path, "gbt")
    history.select("*").write.json(f"{path}/entries/broken/history")  # no commit follows
    assert reports.load_performance_history(spark, path)[0].count() == 1


def test_several_baseline_values_of_a_metric_are_an_error(spark):
    twice = spark.createDataFrame([("mae", 1.0), ("mae", 2.0)], "metric string, value double")
    with pytest.raises(Exception, match="several baseline values"):
        performance.degraded_metrics(records(spark, [9]), twice).collect()
    same = spark.createDataFrame([("mae", 1.0), ("mae", 1.0)], "metric string, value double")
    assert performance.degraded_metrics(records(spark, [9]), same).count() == 1
