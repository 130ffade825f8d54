"""The booster against a plain one, both ways of running it, and its number of jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepulse.plans import boosting
from sitepulse.plans import model as forecast
from sitepulse.plans.boosting import Fit

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 400), rng.integers(0, 5, 400), rng.normal(size=400).round(1) * 0 + 1], 1)
    y = 3.0 * x[:, 0] + 5 * (x[:, 1] > 2) * (x[:, 0] > 4) + rng.integers(0, 4, 400)
    return x.astype(float), y


@pytest.fixture(scope="module")
def binned(spark, rows):
    x, y = rows
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    table = spark.createDataFrame(data, "i long, a double, b double, c double, sessions double").repartition(3)
    edges = boosting.bin_edges(table, NAMES)
    return boosting.bin_rows(table, NAMES, edges, F.col("i"), "sessions").cache(), edges


def plain_tree(x, rest, depth, fit):
    """Value of every row and the function that gives it for others."""
    total, n = rest.sum(), len(rest)
    best, found = boosting.LEAST_GAIN, None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                g, m = rest[left].sum(), left.sum()
                gain = g**2 / (m + fit.l2) + (total - g) ** 2 / (n - m + fit.l2) - total**2 / (n + fit.l2)
                if gain > best + 1e-9:
                    best, found = gain, (f, cut)
    if not found:
        return lambda z: np.full(len(z), fit.rate * total / (n + fit.l2))
    f, cut = found
    left = x[:, f] <= cut
    low = plain_tree(x[left], rest[left], depth - 1, fit)
    high = plain_tree(x[~left], rest[~left], depth - 1, fit)
    return lambda z: np.where(z[:, f] <= cut, low(z), high(z))


def plain_errors(x, y, fit):
    train, held = slice(*fit.train), slice(*fit.held)
    score = np.full(len(y), y[train].mean())
    for _ in range(fit.rounds):
        score = score + plain_tree(x[train], (y - score)[train], fit.depth, fit)(x)
        yield float(np.abs(y - score)[held].mean())


FITS = [
    Fit(depth, rate, rounds, (0, end), (end, end + 100))
    for depth, rate, rounds in ((1, 0.5, 6), (3, 0.3, 4))
    for end in (150, 300)
]


@pytest.mark.parametrize("task_rows", [boosting.TASK_ROWS, 0])
def test_errors_equal_a_plain_booster(rows, binned, task_rows, monkeypatch):
    """In one task a fit, and with rows that stay where they are."""
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    monkeypatch.setattr(boosting, "ROUNDS_TO_CUT", 2)
    grown = boosting.boost(binned[0], FITS, 3)
    for fit, one in zip(FITS, grown):
        assert one.mae == pytest.approx(list(plain_errors(*rows, fit)))


def test_both_ways_grow_the_same_trees(binned, monkeypatch):
    fit = Fit(3, 0.3, 30, (0, 300), (300, 400), patience=2, trees=True)
    one = boosting.boost(binned[0], [fit], 3)[0]
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    two = boosting.boost(binned[0], [fit], 3)[0]
    assert len(one.trees) == len(two.trees) == int(np.argmin(one.mse)) + 1
    assert len(one.mse) <= len(one.trees) + 2 and one.mse == pytest.approx(two.mse)
    for a, b in zip(one.trees, two.trees):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all()
        assert a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)


def test_the_model_scores_like_its_trees(spark, rows, binned):
    x, y = rows
    data = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    table = spark.createDataFrame(data, "a double, b double, c double, sessions double")
    model = forecast.fit(table, NAMES, max_depth=3, n_estimators=5, learning_rate=0.3)
    expected = list(plain_errors(x, y, Fit(3, 0.3, 5, (0, 400), (0, 400))))
    assert forecast.evaluate(model, table).first()["mae"] == pytest.approx(expected[-1])
    shares = {r["feature"]: r["importance"] for r in forecast.feature_importance(model).collect()}
    assert shares["c"] == 0 and sum(shares.values()) == pytest.approx(1)


def test_missing_features_and_constant_targets(spark):
    table = spark.createDataFrame([(float(i % 5), 7.0) for i in range(40)] + [(None, 7.0)], "a double, sessions double")
    model = forecast.fit(table, ["a"], max_depth=2, n_estimators=3)
    assert {r["prediction"] for r in forecast.predict(model, table).collect()} == {7.0}
    lifted = table.withColumn("sessions", F.when(F.col("a").isNull(), 500.0).otherwise(0.0))
    model = forecast.fit(lifted, ["a"], max_depth=2, n_estimators=30, learning_rate=0.5)
    scored = model.transform(lifted)
    assert scored.filter("a IS NULL AND prediction > 400").count() == 1
    assert scored.filter("a IS NOT NULL AND abs(prediction) < 50").count() == 40


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setJobGroup("other", "other")


def test_jobs_do_not_grow_with_the_grid(spark, binned):
    counts = [
        jobs_of(spark, f"boost-{n}", lambda n=n: boosting.boost(binned[0], FITS[:n], 3)) for n in (1, 4)
    ]
    assert counts[0] == counts[1] <= 6


def test_unknown_parameters_are_refused(spark):
    with pytest.raises(ValueError, match="subsample"):
        forecast.fit(spark.range(3).selectExpr("id AS a", "id AS sessions"), ["a"], subsample=0.5)
