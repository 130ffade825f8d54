"""The forecast model: gradient-boosted regression trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults
from ..functions.metrics import regression_metrics
from ..operators.features import align_features
from ..operators.split import INDEX, TOTAL
from .boosting import Fit, Grown, bin_edges, bin_rows, boost

LABEL, PREDICTION = "sessions", "prediction"
KIND = "boosted regression trees"
ABOUT = "kind string, names array<string>, base double, depth int, trees int"
NODES = "tree int, node int, feature int, threshold double, value double, gain double"


@dataclass
class BoostedModel:
    """Trees as heaps, a line each: node i has children 2i+1 (at most ``threshold``) and 2i+2; the
    prediction is ``base`` plus the values of the leaves. Its size follows from the parameters, not from the rows."""

    names: list[str]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @property
    def n_trees(self) -> int:
        return len(self.feature)

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def prediction(self) -> Column:
        """Prediction from the feature columns; a missing feature goes to the right."""
        lines = list(zip(self.feature, self.threshold, self.value))
        base, depth = self.base, self.depth

        def score(*columns):
            import numpy as np
            import pandas as pd

            rows = np.array([c.to_numpy(float, na_value=np.nan) for c in columns])
            at = np.arange(rows.shape[1])
            total = np.full(len(at), base)
            for feature, threshold, value in lines:
                node = np.zeros(len(at), np.int64)
                for _ in range(depth):
                    which = feature[node]
                    right = ~(rows[which, at] <= threshold[node])
                    node = np.where(which >= 0, 2 * node + 1 + right, node)
                total += value[node]
            return pd.Series(total)

        score.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.names])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, self.prediction())


def _model(names: list[str], grown: Grown, edges: list[np.ndarray], depth: int) -> BoostedModel:
    width = 2 ** (depth + 1) - 1
    lines = {c: np.zeros((len(grown.trees), width)) for c in ("feature", "threshold", "value", "gain")}
    for i, tree in enumerate(grown.trees):
        inner = np.flatnonzero(tree.feature >= 0)
        lines["feature"][i] = tree.feature
        lines["threshold"][i, inner] = [edges[f][b] for f, b in zip(tree.feature[inner], tree.bin[inner])]
        lines["value"][i], lines["gain"][i] = tree.value, tree.gain
    return BoostedModel(names, grown.base, lines.pop("feature").astype(int), **lines)


def _parameters(params: Mapping[str, Any]) -> dict[str, Any]:
    known = {"max_depth": defaults.MAX_DEPTH, "learning_rate": defaults.LEARNING_RATE}
    known["n_estimators"] = defaults.N_ESTIMATORS
    unknown = set(params) - set(known)
    if unknown:
        raise ValueError(f"Unknown parameters: {sorted(unknown)}")
    chosen = {**known, **params}
    return {"depth": chosen["max_depth"], "rate": chosen["learning_rate"], "rounds": chosen["n_estimators"]}


def fit(
    train: DataFrame,
    feature_names: list[str],
    validation: DataFrame | None = None,
    patience: int = defaults.EARLY_STOPPING_ROUNDS,
    **params: Any,
) -> BoostedModel:
    """Fit on ``feature_names`` and ``sessions``.

    With validation rows, boosting stops where their squared error has not improved for ``patience``
    rounds, and the trees up to the best round are the model.
    """
    names = list(feature_names)
    edges = bin_edges(train, names)
    rows = bin_rows(train, names, edges, F.lit(0), LABEL)
    if validation is not None:
        rows = rows.union(bin_rows(validation, names, edges, F.lit(1), LABEL))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    settings = _parameters(params)
    held = (1, 2) if validation is not None else (0, 0)
    try:
        wanted = Fit(train=(0, 1), held=held, patience=patience, trees=True, **settings)
        grown = boost(rows, [wanted], len(names))[0]
    finally:
        rows.unpersist()
    return _model(names, grown, edges, settings["depth"])


def feature_names(model: BoostedModel) -> list[str]:
    """The columns the model was trained on, in order."""
    return model.names


def predict(model: BoostedModel | None, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns and ``prediction`` for every row; missing features count as 0."""
    if model is None:
        raise RuntimeError("No model: it is not fitted yet.")
    keep = list(keep)
    names = feature_names(model)
    # Kept columns travel under their own names even when they are features as well.
    rows = df.select(
        *[F.col(c).alias(f"_keep_{c}") for c in keep], *[c for c in names if c in df.columns]
    )
    scored = model.transform(align_features(rows, names, [f"_keep_{c}" for c in keep]))
    return scored.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], PREDICTION)


def actual_and_predicted(model: BoostedModel, rows: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``keep``, ``actual`` and ``predicted``."""
    keep = list(keep)
    scored = predict(model, rows, keep=[*keep, LABEL])
    return scored.select(
        *keep, F.col(LABEL).cast("double").alias("actual"), F.col(PREDICTION).alias("predicted")
    )


def evaluate(model: BoostedModel, rows: DataFrame) -> DataFrame:
    """One row of regression metrics."""
    return actual_and_predicted(model, rows).agg(*regression_metrics())


def comparison_series(model: BoostedModel, rows: DataFrame) -> DataFrame:
    """Actual and predicted demand per site and hour in long form."""
    wide = actual_and_predicted(model, rows, keep=("site_id", "hour"))
    return wide.unpivot(["site_id", "hour"], ["actual", "predicted"], "series", "sessions")


def fold_range(fold: int, splits: int, rows: int) -> tuple[int, int]:
    """``fold_bounds`` for a known number of rows."""
    size = rows // (splits + 1)
    start = rows - (splits - fold) * size
    return start, start + size


def _fold_errors(
    indexed: DataFrame, names: list[str], splits: int, grid: list[Mapping[str, Any]]
) -> list[list[float]]:
    """MAE per grid point and fold, all from the same jobs.

    Trees are added one by one, so points that differ only in the number of rounds share the fit
    with the most of them, and its error after each round gives all of theirs. Bins are those of all rows.
    """
    points = [_parameters(p) for p in grid]
    families: dict[tuple, int] = {}
    for p in points:
        key = p["depth"], p["rate"]
        families[key] = max(families.get(key, 0), p["rounds"])
    edges = bin_edges(indexed, names)
    binned = bin_rows(indexed, names, edges, F.col(INDEX), LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = indexed.agg(F.max(TOTAL)).first()[0] or 0
        bounds = [fold_range(fold, splits, total) for fold in range(splits)]
        fits = [
            Fit(depth, rate, rounds, train=(0, start), held=(start, end))
            for (depth, rate), rounds in families.items()
            for start, end in bounds
        ]
        grown = boost(binned, fits, len(names))
    finally:
        binned.unpersist()
    places = {key: i * splits for i, key in enumerate(families)}
    return [
        [grown[places[p["depth"], p["rate"]] + fold].mae[p["rounds"] - 1] for fold in range(splits)]
        for p in points
    ]


def cross_validate(
    indexed: DataFrame, names: list[str], splits: int = defaults.CV_SPLITS, **params: Any
) -> DataFrame:
    """MAE of every expanding-window fold over rows that carry a ``row_index``."""
    errors = _fold_errors(indexed, names, splits, [params])[0]
    spark = indexed.sparkSession
    return spark.createDataFrame(list(enumerate(errors)), "fold int, mae double")


def score_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold errors."""
    return fold_scores.agg(
        F.avg("mae").alias("mean_score"),
        F.stddev_pop("mae").alias("std_score"),
        F.lit("mae").alias("metric"),
    )


def parameter_grid(grid: Mapping[str, Iterable[Any]] = defaults.TUNING_GRID) -> list[dict[str, Any]]:
    """Every combination of the grid values."""
    return [dict(zip(grid, point)) for point in itertools.product(*grid.values())]


def tune(
    indexed: DataFrame,
    names: list[str],
    grid: Mapping[str, Iterable[Any]] = defaults.TUNING_GRID,
    splits: int = defaults.TUNING_SPLITS,
    **params: Any,
) -> tuple[BoostedModel, dict[str, Any], DataFrame]:
    """Grid search by mean fold MAE; returns the refitted best model, its parameters, all scores."""
    points = [{**params, **point} for point in parameter_grid(grid)]
    errors = _fold_errors(indexed, names, splits, points)
    means = [sum(e) / len(e) for e in errors]
    best = points[means.index(min(means))]
    scores = indexed.sparkSession.createDataFrame(
        [
            (
                int(p.get("max_depth", defaults.MAX_DEPTH)),
                float(p.get("learning_rate", defaults.LEARNING_RATE)),
                int(p.get("n_estimators", defaults.N_ESTIMATORS)),
                float(m),
                p is best,
            )
            for p, m in zip(points, means)
        ],
        "max_depth int, learning_rate double, n_estimators int, mean_mae double, is_best boolean",
    )
    return fit(indexed, names, **best), best, scores


def feature_importance(model: BoostedModel) -> DataFrame:
    """Mean gain of the splits on each feature as a share of all, smallest first."""
    if model is None:
        raise RuntimeError("No model: it is not fitted yet.")
    inner = model.feature >= 0
    n = len(model.names)
    splits = np.bincount(model.feature[inner], minlength=n)
    means = np.bincount(model.feature[inner], model.gain[inner], n) / np.maximum(splits, 1)
    shares = means / (means.sum() or 1.0)
    pairs = list(zip(model.names, shares.tolist()))
    spark = SparkSession.active()
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        "importance", "feature"
    )


def save_model(model: BoostedModel, path: str) -> str:
    """Write the model, replacing what is there: a row per node and one that describes them."""
    spark = SparkSession.active()
    tree, node = np.nonzero((model.feature >= 0) | (model.value != 0))
    columns = (model.feature, model.threshold, model.value, model.gain)
    rows = zip(tree.tolist(), node.tolist(), *[c[tree, node].tolist() for c in columns])
    spark.createDataFrame(list(rows), NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(KIND, model.names, model.base, model.depth, model.n_trees)]
    spark.createDataFrame(about, ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return path


def load_model(path: str) -> BoostedModel:
    """Read a model and check that it is a forecast model."""
    spark = SparkSession.active()
    try:
        about = spark.read.schema(ABOUT).json(f"{path}/about").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        about = None
    if about is None or about["kind"] != KIND:
        raise TypeError(f"Expected a boosted-tree forecast model: {path}")
    shape = about["trees"], 2 ** (about["depth"] + 1) - 1
    feature = np.full(shape, -1)
    threshold, value, gain = (np.zeros(shape) for _ in range(3))
    for r in spark.read.schema(NODES).parquet(f"{path}/nodes").collect():  # bounded like the model
        at = r["tree"], r["node"]
        feature[at], threshold[at], value[at], gain[at] = r["feature"], r["threshold"], r["value"], r["gain"]
    return BoostedModel(about["names"], about["base"], feature, threshold, value, gain)
