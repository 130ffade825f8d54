"""Scoring of requests as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.requests import name_rules, rejected_requests, valid_requests, validate_requests
from ..plans.model import BoostedModel
from ..plans.scoring import score_requests
from ..sources.requests import stream_requests


def start_scoring(
    spark: SparkSession,
    requests_dir: str,
    model: BoostedModel,
    output_dir: str,
    checkpoint_dir: str,
    model_version: str = "unknown",
    **trigger,
) -> StreamingQuery:
    """Score valid requests from ``requests_dir`` into Parquet files.

    Scoring is stateless; files and checkpoint make it resume where it stopped. ``trigger``
    is passed on, ``availableNow=True`` by default.
    """
    arriving = valid_requests(validate_requests(stream_requests(spark, requests_dir)))
    scored = score_requests(arriving, model, model_version).observe(
        "scored", F.count(F.lit(1)).alias("rows")
    )
    return (
        scored.writeStream.format("parquet")
        .option("path", output_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_rejects(
    spark: SparkSession, requests_dir: str, output_dir: str, checkpoint_dir: str, **trigger
) -> StreamingQuery:
    """Write the invalid requests: their text and the fields that broke a rule."""
    refused = rejected_requests(validate_requests(stream_requests(spark, requests_dir)))
    return (
        refused.writeStream.format("json")
        .option("path", output_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def answer_batch(
    requests: DataFrame, batch: int, model: BoostedModel, answers_dir: str, refused_dir: str, model_version: str
) -> None:
    """Write the scores of the valid requests and the refused ones, each in a folder of the batch.

    The folder is replaced as a whole, so a batch that is run again after a crash leaves no row twice.
    """
    checked = validate_requests(requests).persist()
    try:
        scored = score_requests(valid_requests(checked), model, model_version)
        scored.write.mode("overwrite").parquet(f"{answers_dir}/batch={batch}")
        refused = name_rules(rejected_requests(checked)).select("raw", "rejects", "rules")
        refused.write.mode("overwrite").parquet(f"{refused_dir}/batch={batch}")
    finally:
        checked.unpersist()


def start_answering(
    spark: SparkSession,
    requests_dir: str,
    model: BoostedModel,
    answers_dir: str,
    refused_dir: str,
    checkpoint_dir: str,
    model_version: str = "unknown",
    **trigger,
) -> StreamingQuery:
    """One stream that reads every request once and writes scores and refused requests.

    Refused requests keep their text as it came and name the rules they break. Both folders are
    partitioned by ``batch``. ``trigger`` is passed on, ``availableNow=True`` by default.
    """

    def answer(requests: DataFrame, batch: int) -> None:
        answer_batch(requests, batch, model, answers_dir, refused_dir, model_version)

    return (
        stream_requests(spark, requests_dir)
        .writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
