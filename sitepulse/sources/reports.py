"""Reading and writing of monitoring history, training results and named models."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.model import BoostedModel, save_model

RECORD_SCHEMA = (
    "timestamp timestamp_ntz, mae double, rmse double, mape double, r2 double, sample_size bigint"
)
BASELINE_SCHEMA = "model_name string, metric string, value double"
RESULT_SCHEMA = "section string, name string, value double, detail string"
_ORDER = "seq bigint, saver string"
COMMIT_SCHEMA = f"{_ORDER}, replaces array<string>"


def _commits(spark: SparkSession, path: str) -> list[Row]:
    """The saves in force, in order: those that are complete and that no compaction replaced."""
    try:
        found = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    replaced = {saver for commit in found for saver in commit["replaces"] or ()}
    return sorted((c for c in found if c["saver"] not in replaced), key=lambda c: (c["seq"], c["saver"]))


def _read_entries(spark: SparkSession, path: str, commits: list[Row]) -> tuple[DataFrame, DataFrame]:
    """Rows of those saves with the place of the save that they come from."""
    folders = [f"{path}/entries/{c['saver']}" for c in commits]
    history = f"model_name string, {RECORD_SCHEMA}, {_ORDER}"
    return (
        spark.read.schema(history).json([f"{f}/history" for f in folders]),
        spark.read.schema(f"{BASELINE_SCHEMA}, {_ORDER}").json([f"{f}/baseline" for f in folders]),
    )


def _in_force(history: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each record the last save, of each model the baseline of the last save that has one."""
    order = F.struct("seq", "saver")
    last = F.max_by(F.struct(*history.columns), order)
    rows = history.groupBy("model_name", "timestamp").agg(last.alias("_r")).select("_r.*")
    newest = Window.partitionBy("model_name").orderBy(F.desc("seq"), F.desc("saver"))
    named = baseline.withColumn("_place", F.rank().over(newest)).filter("_place = 1").drop("_place")
    return rows, named


def _write_entry(history: DataFrame, baseline: DataFrame, path: str, seq: int, saver: str, replaces: list[str]) -> None:
    history.write.json(f"{path}/entries/{saver}/history")
    baseline.write.json(f"{path}/entries/{saver}/baseline")
    commit = history.sparkSession.createDataFrame([(seq, saver, replaces)], COMMIT_SCHEMA)
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")  # makes the entry visible


def save_performance_history(
    records: DataFrame, baseline: DataFrame, path: str, model_name: str
) -> None:
    """Add the records and replace the baseline metrics (``metric, value``) of the model.

    A save writes its own rows in a folder of its own and then a small commit, so its cost does not
    depend on the history, a save that fails leaves no trace, and what is read, also from the
    same ``path``, is never overwritten. Its number is one above all that it saw; saves that run at once may
    get the same number, both count, and the name of the folder decides which comes first. Records are known by model
    and timestamp: saving them again changes nothing.
    """
    spark = records.sparkSession
    seq = max((c["seq"] for c in _commits(spark, path)), default=0) + 1
    saver = uuid.uuid4().hex
    place = F.lit(seq).cast("bigint").alias("seq"), F.lit(saver).alias("saver")
    model = F.lit(model_name).alias("model_name")
    rows = records.select(model, "timestamp", "mae", "rmse", "mape", "r2", "sample_size", *place)
    named = baseline.select(model, "metric", F.col("value").cast("double").alias("value"), *place)
    _write_entry(rows, named, path, seq, saver, [])


def compact_performance_history(spark: SparkSession, path: str) -> None:
    """Write what is in force as one entry that replaces those it was made from.

    Rows keep the place of their save, so a save that runs at the same time is neither lost nor
    overtaken. Replaced folders are not read any more; they may be deleted once no reader is left.
    """
    commits = _commits(spark, path)
    if len(commits) > 1:
        rows, named = _in_force(*_read_entries(spark, path, commits))
        replaced = [c["saver"] for c in commits]
        _write_entry(rows, named, path, commits[-1]["seq"], uuid.uuid4().hex, replaced)


def load_performance_history(
    spark: SparkSession, path: str, model_name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The records and the baseline metrics as last saved, of one model or of all."""
    commits = _commits(spark, path)
    if not commits:
        raise FileNotFoundError(f"No performance history: {path}")
    records, baseline = (rows.drop("seq", "saver") for rows in _in_force(*_read_entries(spark, path, commits)))
    if model_name is not None:
        chosen = F.col("model_name") == model_name
        records, baseline = records.filter(chosen), baseline.filter(chosen)
    return records.drop("model_name"), baseline


def save_training_results(
    results: DataFrame, output_dir: str, filename: str = "training_results.json"
) -> str:
    """Write the results table as JSON lines."""
    path = f"{output_dir}/{filename}"
    results.write.mode("overwrite").json(path)
    return path


def load_training_results(
    spark: SparkSession, output_dir: str, filename: str = "training_results.json"
) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(f"{output_dir}/{filename}")


def save_named_model(
    models: Mapping[str, BoostedModel],
    name: str,
    output_dir: str = "models",
    include_timestamp: bool = True,
    now: datetime | None = None,
) -> str:
    """Save one of ``models`` under its name, by default with the time in the path."""
    if name not in models:
        raise ValueError(f"Model {name} not found")
    stamp = f"_{(now or datetime.now()):%Y%m%d_%H%M%S}" if include_timestamp else ""
    return save_model(models[name], f"{output_dir}/{name}{stamp}")
