import itertools
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepulse.functions import significance
from sitepulse.operators import drift


def gap(a, b):
    points = np.unique(np.concatenate([a, b]))
    below_a = np.searchsorted(np.sort(a), points, side="right") / len(a)
    below_b = np.searchsorted(np.sort(b), points, side="right") / len(b)
    return np.abs(below_a - below_b).max()


@pytest.mark.parametrize(("m", "n"), [(3, 5), (4, 4), (6, 3), (1, 7), (5, 6)])
def test_exact_ks_p_value_is_the_share_of_orderings(m, n):
    gaps = []
    for chosen in itertools.combinations(range(m + n), m):
        a = np.array(chosen, dtype=float)
        b = np.array([i for i in range(m + n) if i not in chosen], dtype=float)
        gaps.append(gap(a, b))
    gaps = np.array(gaps)
    for d in np.unique(gaps.round(12)):
        assert significance._ks_exact(d, m, n) == pytest.approx((gaps >= d - 1e-9).mean(), abs=1e-12)
    assert significance._ks_exact(0.0, m, n) == 1.0


def ks_limits(spark, cases):
    df = spark.createDataFrame(cases, "d double, m bigint, n bigint")
    return [r[0] for r in df.select(significance.ks_p_value(F.col("d"), F.col("m"), F.col("n"))).collect()]


def test_limit_agrees_with_exact_for_large_samples(spark):
    cases = [(d, 5000, 4000) for d in (0.02, 0.03, 0.05)]
    for case, limit in zip(cases, ks_limits(spark, cases)):
        assert limit == pytest.approx(significance._ks_exact(*case), rel=0.05, abs=1e-4)


def test_the_p_value_does_not_jump_with_the_size(spark):
    for d in (0.0, 0.005, 0.015, 0.02, 0.03):
        some = ks_limits(spark, [(d, n, n) for n in (9_999, 10_000, 10_001)])
        assert max(some) - min(some) < 1e-3 and 0 <= min(some) <= max(some) <= 1


def test_exact_only_on_request(spark):
    df = spark.createDataFrame([(0.6, 5, 5)], "d double, m bigint, n bigint")
    columns = [F.col(c) for c in ("d", "m", "n")]
    assert df.select(significance.ks_p_value(*columns, "exact")).first()[0] == pytest.approx(
        significance._ks_exact(0.6, 5, 5)
    )
    with pytest.raises(ValueError):
        significance.ks_p_value(*columns, "guess")


def test_mann_whitney_p(spark):
    cases = [(700.0, 30, 40, 0.0), (500.0, 30, 40, 0.0), (450.0, 30, 30, 60.0**3 - 60), (1150.0, 30, 40, 0.0)]
    df = spark.createDataFrame(cases, "u double, m bigint, n bigint, ties double")
    p = significance.mann_whitney_p_value(*[F.col(c) for c in ("u", "m", "n", "ties")])
    got = [r[0] for r in df.select(p).collect()]
    for (u, *_), found in zip((cases[0], cases[1], cases[3]), (got[0], got[1], got[3])):
        # Without ties: sigma^2 = m n (m + n + 1) / 12.
        z = (abs(u - 30 * 40 / 2) - 0.5) / math.sqrt(30 * 40 * 71 / 12)
        assert found == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    assert got[2] == 1.0


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    ref = [(float(x), float(y), 1.0) for x, y in zip(rng.integers(0, 12, 150), rng.normal(0, 1, 150))]
    new = [(float(x), float(y), 1.0) for x, y in zip(rng.integers(4, 14, 90), rng.normal(0, 1, 90))]
    schema = "ties double, smooth double, constant double"
    return (
        spark.createDataFrame(ref, schema).repartition(3),
        spark.createDataFrame(new, schema).repartition(3),
        np.array(ref),
        np.array(new),
    )


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_statistics_match_brute_force(spark, samples, coalesce):
    ref_df, new_df, ref, new = samples
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {
            r["feature"]: r
            for r in drift.compare_samples(ref_df, new_df, ["ties", "smooth", "constant"]).collect()
        }
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, name in enumerate(("ties", "smooth", "constant")):
        a, b = ref[:, i], new[:, i]
        row = got[name]
        assert (row["n_ref"], row["n_new"]) == (150, 90)
        assert row["ks_statistic"] == pytest.approx(gap(a, b), abs=1e-12)
        wins = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert row["mw_statistic"] == pytest.approx(wins)
        _, counts = np.unique(np.concatenate([a, b]), return_counts=True)
        assert row["tie_sum"] == pytest.approx((counts.astype(float) ** 3 - counts).sum())


def test_report_summary_and_alert(spark, samples):
    ref_df, new_df, *_ = samples
    few = new_df.selectExpr("*", "if(ties > 12, ties, null) AS rare", "'x' AS text", "1 AS unknown")
    report = drift.detect_drift(ref_df.selectExpr("*", "ties AS rare"), few)
    rows = {r["feature"]: r for r in report.collect()}
    assert set(rows) == {"ties", "smooth", "constant"}
    assert rows["ties"]["ks_drift"] and rows["ties"]["mw_drift"]
    assert not rows["constant"]["drift_detected"] and rows["constant"]["ks_p_value"] == 1.0
    summary = drift.drift_summary(report, few)
    row = summary.first()
    assert row["total_features_tested"] == 5 and row["features_with_drift"] >= 1
    assert row["drift_percentage"] == pytest.approx(row["features_with_drift"] / 5 * 100)
    alert = drift.drift_alerts(summary, datetime(2024, 2, 1)).collect()
    assert len(alert) == 1 and "ties" in alert[0]["message"] and "2024-02-01" in alert[0]["message"]
    calm = drift.drift_summary(drift.detect_drift(ref_df, ref_df), ref_df)
    assert calm.first()["drift_percentage"] == 0.0
    assert drift.drift_alerts(calm, datetime(2024, 2, 1)).count() == 0


def test_no_numeric_column(spark, samples):
    report = drift.detect_drift(samples[0], samples[1])
    text = spark.createDataFrame([("a",)], "t string")
    assert drift.drift_summary(report.filter("false"), text).first()["drift_percentage"] is None
