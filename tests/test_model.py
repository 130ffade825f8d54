from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SESSIONS

from sitepulse.operators import split
from sitepulse.plans import model as forecast
from sitepulse.plans import training
from sitepulse.sources import reports

SMALL = {"max_depth": 3, "n_estimators": 8, "learning_rate": 0.5}


@pytest.fixture(scope="module")
def sessions(spark):
    """Two sites with a strong daily pattern and noise."""
    rng = np.random.default_rng(1)
    start = datetime(2024, 1, 1)
    rows = []
    for site in (1, 2):
        for h in range(600):
            mean = 20 * site + 10 * np.sin(2 * np.pi * h / 24)
            rows.append((site, start + timedelta(hours=h), float(mean + rng.normal(0, 1))))
    return spark.createDataFrame(rows, SESSIONS)


@pytest.fixture(scope="module")
def prepared(sessions):
    rows, names = training.prepare_data(sessions)
    return rows.cache(), names


@pytest.fixture(scope="module")
def model(prepared):
    rows, names = prepared
    return forecast.fit(rows.filter("split = 'train'"), names, **SMALL)


def test_model_learns_the_pattern(prepared, model):
    rows, names = prepared
    assert len(names) == 25 and forecast.feature_names(model) == names
    row = forecast.evaluate(model, rows.filter("split = 'test'")).first()
    assert row["r2"] > 0.9 and row["sample_size"] == int(2 * (600 - 168) * 0.2)


def test_model_beats_a_poor_forecast(prepared, model):
    test = prepared[0].filter("split = 'test'")
    mae = forecast.evaluate(model, test).first()["mae"]
    naive = test.selectExpr("avg(abs(sessions - lag_1)) AS mae").first()["mae"]
    assert mae < naive


def test_columns_are_aligned_before_prediction(prepared, model):
    rows, names = prepared
    test = rows.filter("split = 'test'")
    straight = forecast.predict(model, test, ["site_id", "hour"]).orderBy("site_id", "hour").collect()
    shuffled = test.select("site_id", "hour", *reversed(names))
    again = forecast.predict(model, shuffled, ["site_id", "hour"]).orderBy("site_id", "hour").collect()
    assert straight == again
    assert forecast.predict(model, test.select("site_id", "lag_1"), ["lag_1"]).count() == len(straight)
    with pytest.raises(RuntimeError, match="not fitted"):
        forecast.predict(None, test)


def test_saved_model_predicts_the_same(spark, prepared, model, tmp_path):
    test = prepared[0].filter("split = 'test'")
    now = datetime(2024, 5, 6, 7, 8, 9)
    path = reports.save_named_model({"gbt": model}, "gbt", str(tmp_path), now=now)
    assert path.endswith("gbt_20240506_070809")
    back = forecast.predict(forecast.load_model(path), test, ["site_id", "hour"])
    want = forecast.predict(model, test, ["site_id", "hour"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="not found"):
        reports.save_named_model({}, "gbt", str(tmp_path))


def test_other_artifacts_are_refused(prepared, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows, _ = prepared
    path = str(tmp_path / "other")
    Pipeline(stages=[VectorAssembler(inputCols=["lag_1"], outputCol="v")]).fit(rows).save(path)
    with pytest.raises(TypeError):
        forecast.load_model(path)


def test_early_stopping_keeps_the_first_trees(prepared):
    rows, names = prepared
    train, held_out = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    noisy = held_out.withColumn("sessions", held_out.sessions * 0)
    stopped = forecast.fit(train, names, noisy, patience=1, **SMALL)
    full = forecast.fit(train, names, **SMALL)
    assert 0 < stopped.n_trees < full.n_trees == 8
    for part in ("feature", "threshold", "value"):
        assert (getattr(stopped, part) == getattr(full, part)[: stopped.n_trees]).all()


def test_no_validation_rows_means_no_early_stopping(prepared):
    rows, names = prepared
    train = rows.filter("split = 'train'")
    assert forecast.fit(train, names, train.limit(0), patience=1, **SMALL).n_trees == 8


def test_importance(prepared, model):
    rows = forecast.feature_importance(model).collect()
    values = [r["importance"] for r in rows]
    assert {r["feature"] for r in rows} == set(prepared[1])
    assert values == sorted(values) and sum(values) == pytest.approx(1)


def test_cross_validation_and_tuning(prepared):
    rows, names = prepared
    train = training.indexed_training_part(rows)
    folds = forecast.cross_validate(train, names, splits=3, **SMALL)
    scores = [r["mae"] for r in folds.orderBy("fold").collect()]
    assert len(scores) == 3 and all(s > 0 for s in scores)
    summary = forecast.score_summary(folds).first()
    assert summary["mean_score"] == pytest.approx(np.mean(scores))
    assert summary["std_score"] == pytest.approx(np.std(scores))
    grid = {"max_depth": (1, 3), "n_estimators": (4,)}
    model, best, table = forecast.tune(train, names, grid, splits=2)
    rows = table.collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    assert best["max_depth"] == 3 and model.n_trees == 4
    assert min(r["mean_mae"] for r in rows) == next(r["mean_mae"] for r in rows if r["is_best"])
    assert len(forecast.parameter_grid()) == 12


def test_points_that_share_a_fit_score_as_if_fitted_alone(prepared):
    rows, names = prepared
    train = training.indexed_training_part(rows)
    grid = {"max_depth": (2,), "n_estimators": (3, 6)}
    scores = forecast.tune(train, names, grid, splits=2)[2].collect()
    for row in scores:
        alone = []
        for fold in range(2):
            part = train.withColumn("part", split.fold_part(fold, 2))
            params = {"max_depth": 2, "n_estimators": row["n_estimators"]}
            fitted = forecast.fit(part.filter("part = 'train'"), names, **params)
            alone.append(forecast.evaluate(fitted, part.filter("part = 'test'")).first()["mae"])
        assert row["mean_mae"] == pytest.approx(np.mean(alone), rel=0.05)  # bins differ
    assert {r["n_estimators"] for r in scores} == {3, 6}


def test_full_run(spark, sessions, tmp_path):
    model, results = training.run_training(sessions, str(tmp_path), cv_splits=2, **SMALL)
    saved = reports.load_training_results(spark, str(tmp_path))
    rows = results.collect()
    assert sorted(map(str, saved.collect())) == sorted(
        str(r) for r in rows if r["section"] != "artifact"
    )
    paths = {r["name"]: r["detail"] for r in rows if r["section"] == "artifact"}
    assert paths["current_model_path"] == f"{tmp_path}/gbt" and len(paths) == 3
    values = {(r["section"], r["name"]): r["value"] for r in saved.collect()}
    assert {section for section, _ in values} == {"cross_validation", "test"}
    folds = [values["cross_validation", f"fold_{i}"] for i in range(2)]
    assert values["cross_validation", "mean_score"] == pytest.approx(np.mean(folds))
    assert values["cross_validation", "std_score"] == pytest.approx(np.std(folds))
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names[0] == "gbt" and names[1].startswith("gbt_2") and "training_results.json" in names
    forecast.load_model(str(tmp_path / "gbt"))


def test_tuned_run(sessions):
    grid = {"max_depth": (2,), "learning_rate": (0.1, 0.3), "n_estimators": (3,)}
    _, results = training.run_training(
        sessions, tuning=True, grid=grid, tuning_splits=2, cross_validation=False
    )
    names = [r["name"] for r in results.filter("section = 'tuning'").collect()]
    assert sorted(names) == ["best", "candidate"]


def test_baseline(sessions):
    model, metrics = training.baseline_fit(sessions, **SMALL)
    assert len(forecast.feature_names(model)) == 8 and metrics.first()["mae"] > 0


def test_comparison_series(prepared, model):
    test = prepared[0].filter("split = 'test'")
    series = forecast.comparison_series(model, test)
    counts = {r[0]: r[1] for r in series.groupBy("series").count().collect()}
    assert counts == {"actual": test.count(), "predicted": test.count()}


def test_missing_features_are_left_out(prepared):
    assert training.available_features(prepared[0].select("lag_1", "hour_sin")) == ["hour_sin", "lag_1"]


def test_training_part_is_the_oldest(prepared):
    train = training.indexed_training_part(prepared[0])
    row = train.selectExpr("min(row_index)", "max(row_index)", "max(row_total)", "count(*)").first()
    assert row[0] == 0 and row[1] + 1 == row[2] == row[3]
    assert split.INDEX in train.columns
