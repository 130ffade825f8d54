import numpy as np
import pandas as pd
import pytest

from sitepulse.functions import comoments
from sitepulse.operators import profile
from sitepulse.operators.features import create_feature_table
from sitepulse.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def table(long_series):
    return create_feature_table(long_series).cache()


def test_correlation_matrix_matches_pandas(table):
    columns = profile.family_columns(table, ("Temporal", "Rolling Stats", "Lag", "Binary"))
    assert columns[-1] == "sessions" and len(columns) == len(set(columns))
    want = table.select(*columns).toPandas().astype(float).corr()
    for a, b, r in profile.correlation_matrix(table, columns).collect():
        if np.isnan(want.loc[a, b]):
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)


def test_target_correlation_order_and_flags(table):
    rows = profile.correlation_with_target(table).collect()
    values = [r["correlation"] for r in rows if r["correlation"] is not None]
    assert values == sorted(values)
    holiday = next(r for r in rows if r["feature"] == "is_holiday")
    assert holiday["correlation"] is None and holiday["is_positive"] is False
    assert {"site_id", "hour", "state", "sessions"}.isdisjoint(r["feature"] for r in rows)


@pytest.mark.parametrize("shape", ["ties", "spread", "constant", "one"])
def test_quantiles_match_numpy(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "ties": np.concatenate([np.full(300, 5.0), rng.integers(0, 9, 200).astype(float)]),
        "spread": np.exp(rng.normal(0, 20, 501)),
        "constant": np.full(40, 1.25),
        "one": np.array([3.5]),
    }[shape]
    pdf = pd.DataFrame({"x": [*values, None], "y": [1.0, *values[::-1]]})
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    wanted = {"low": 0.0, "a": 0.1, "q25": 0.25, "median": 0.5, "c": 0.815, "high": 1.0}
    got = {r["feature"]: r for r in exact_quantiles(df, ["x", "y"], wanted).collect()}
    for name, data in (("x", values), ("y", [1.0, *values])):
        for key, p in wanted.items():
            assert got[name][key] == pytest.approx(np.quantile(data, p), rel=1e-12)


def test_quantiles_over_many_buckets(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("cast(pow(id % 997, 3) AS double) AS x")
        got = exact_quantiles(df, ["x"], {"q": 0.333}).first()["q"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(np.quantile((np.arange(5000) % 997) ** 3.0, 0.333))


def test_histogram(spark):
    df = spark.createDataFrame(
        [(float(i), 4.0) for i in range(61)] + [(None, 4.0)], "x double, c double"
    )
    rows = profile.histogram(df, ["x", "c"]).collect()
    x = {r["bin"]: r["count"] for r in rows if r["feature"] == "x"}
    assert len(x) == 30 and x[29] == 3 and sum(x.values()) == 61
    constant = [r for r in rows if r["feature"] == "c"]
    assert [(r["bin"], r["count"], r["lower"], r["upper"]) for r in constant] == [(0, 62, 4.0, 4.0)]


def test_box_and_reference_stats(spark, long_series):
    data = long_series.select("sessions").toPandas()["sessions"].dropna()
    box = profile.box_stats(long_series, ["sessions"]).first()
    assert (box["min"], box["max"]) == (data.min(), data.max())
    assert [box["q25"], box["median"], box["q75"]] == list(data.quantile([0.25, 0.5, 0.75]))
    stats = {r["feature"]: r for r in profile.reference_stats(long_series).collect()}
    assert set(stats) == {"site_id", "sessions"}
    centred = data - data.mean()
    biased = (centred**3).mean() / (centred**2).mean() ** 1.5
    assert stats["sessions"]["skewness"] == pytest.approx(biased)
    flat = spark.createDataFrame([(2.0,)] * 5, "v double")
    row = profile.reference_stats(flat).first()
    assert row["std"] == 0.0 and row["skewness"] is None


def test_blocks_merge_to_the_block_of_all_rows():
    rng = np.random.default_rng(8)
    values = rng.normal(size=(900, 4)) + [0, 1e7, -3, 5]
    values[:, 2] += 2 * values[:, 0]
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:300, 3] = np.nan  # a task without any value of a column
    whole = comoments.block_of(values)
    merged = comoments.block_of(values[:300])
    for part in (values[300:301], values[301:700], values[700:]):
        merged = comoments.merge_blocks(merged, comoments.block_of(part))
    want = pd.DataFrame(values).corr().to_numpy()
    for block in (whole, merged):
        assert comoments.correlations_of(block) == pytest.approx(want, abs=1e-9)
    assert (merged[0] == whole[0]).all() and (merged[4:] == whole[4:]).all()


def test_correlation_sends_blocks_not_rows(table):
    plan = profile.correlation_matrix(table)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
    assert profile.correlation_matrix(table.limit(0)).count() == 0


def test_correlation_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(comoments, "MERGED", 2)
    df = spark.range(0, 500, 1, 7).selectExpr("id AS x", "pow(id, 2) AS y", "IF(id < 250, 3, NULL) AS z")
    got = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df, ["x", "y", "z"]).collect()}
    x = np.arange(500.0)
    assert got["x", "y"] == pytest.approx(np.corrcoef(x, x**2)[0, 1])
    assert got["x", "z"] is None and got["y", "z"] is None


def test_quantiles_write_only_what_lies_in_the_brackets(spark, monkeypatch):
    """Values outside the brackets are counted, not kept, and the result is exact."""
    from sitepulse.operators import quantiles

    written = []
    plain = quantiles.write_sorted

    def counted(df, *order):
        out = plain(df, *order)
        written.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "write_sorted", counted)
    monkeypatch.setattr(quantiles, "SKETCH", 200)
    rng = np.random.default_rng(5)
    values = np.exp(rng.normal(0, 3, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": -values})).repartition(6)
    wanted = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    for row in exact_quantiles(df, ["x", "y"], wanted).collect():
        data = values if row["feature"] == "x" else -values
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(data, p), rel=1e-12)
    assert written[0] < 0.15 * 2 * len(values)
