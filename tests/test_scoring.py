import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation

from sitepulse.operators import requests as ops
from sitepulse.operators.features import model_feature_names
from sitepulse.plans import model as forecast
from sitepulse.plans.scoring import score_requests
from sitepulse.sources.requests import REQUEST_SCHEMA, parse_requests, read_requests
from sitepulse.streaming.scoring import answer_batch, start_answering, start_rejects, start_scoring

# A request as clients send it.
SAMPLE = {
    "site_id": 1,
    "timestamp": "2024-01-15T14:30:00Z",
    "hour_of_day": 14,
    "day_of_week": 0,
    "is_weekend": 0,
    "hour_sin": 0.5,
    "hour_cos": 0.866,
    "lag_1": 5.2,
    "lag_24": 4.8,
    "rmean_24": 5.0,
}


def frame(spark, *changes):
    return spark.createDataFrame([{**SAMPLE, **c} for c in changes], REQUEST_SCHEMA)


@pytest.mark.parametrize(
    ("change", "rejects"),
    [
        ({}, []),
        ({"lag_1": None, "lag_24": None, "rmean_24": None}, []),
        ({"site_id": 0}, ["site_id"]),
        ({"site_id": -1}, ["site_id"]),
        ({"site_id": None}, ["site_id"]),
        ({"hour_of_day": 25}, ["hour_of_day"]),
        ({"day_of_week": 7}, ["day_of_week"]),
        ({"is_weekend": 2}, ["is_weekend"]),
        ({"hour_sin": 1.5}, ["hour_sin"]),
        ({"hour_cos": None}, ["hour_cos"]),
        ({"lag_1": -0.1, "rmean_24": -1.0}, ["lag_1", "rmean_24"]),
        ({"timestamp": "not-a-timestamp", "site_id": 0}, ["site_id", "timestamp"]),
        ({"timestamp": None}, ["timestamp"]),
    ],
)
def test_rules(spark, change, rejects):
    assert ops.validate_requests(frame(spark, change)).first()["rejects"] == rejects


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("2024-01-15", True),
        ("2024-01-15 14:30", True),
        ("2024-01-15T14:30:00.123", True),
        ("2024-01-15T14:30:00.123456+05:30", True),
        ("2024-02-29T00:00:00Z", True),
        ("2023-02-29T00:00:00Z", False),
        ("2024-13-01T14:30:00Z", False),
        ("2024-01-32T14:30:00Z", False),
        ("2024-01-15T24:00:00Z", False),
        ("2024-01-15T14:60:00Z", False),
        ("2024-1-5", False),
        ("2024", False),
        ("0000-01-01", False),
    ],
)
def test_timestamps(spark, text, valid):
    got = ops.validate_requests(frame(spark, {"timestamp": text})).first()["rejects"]
    assert got == ([] if valid else ["timestamp"])


def test_request_features(spark):
    names = model_feature_names()
    row = ops.request_features(frame(spark, {"lag_24": None}), names).first()
    assert list(row.asDict()) == names
    assert (row["lag_1"], row["lag_24"], row["lag_168"], row["rmax_72"]) == (5.2, 0.0, 0.0, 0.0)
    bare = frame(spark, {}).drop("lag_1", "lag_24", "rmean_24")
    assert ops.request_features(bare, names).first()["lag_1"] == 0.0


@pytest.fixture(scope="module")
def model(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(hours=i), float(i % 24), i % 24, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(
        rows, "site_id bigint, hour timestamp_ntz, sessions double, hour_of_day int, lag_1 double"
    )
    return forecast.fit(df, ["hour_of_day", "lag_1", "lag_168"][:2], max_depth=3, n_estimators=4)


def test_scores(spark, model):
    seen = Observation("scored")
    scored = score_requests(frame(spark, {}, {"site_id": 7}), model, "1.0.0", seen)
    rows = sorted(scored.collect(), key=lambda r: r["site_id"])
    assert scored.columns == [
        "prediction", "site_id", "timestamp", "model_version", "confidence_interval",
    ]
    assert [r["site_id"] for r in rows] == [1, 7] and rows[0]["model_version"] == "1.0.0"
    for r in rows:
        band = r["confidence_interval"]
        assert band["lower"] == pytest.approx(r["prediction"] * 0.9)
        assert band["upper"] == pytest.approx(r["prediction"] * 1.1)
    assert seen.get["scored"] == 2
    with pytest.raises(RuntimeError, match="not loaded"):
        score_requests(frame(spark, {}), None)


def test_stream_equals_batch(spark, model, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    good = [{**SAMPLE, "site_id": i, "hour_of_day": i % 24} for i in range(1, 31)]
    bad = [{**SAMPLE, "site_id": 0}, {**SAMPLE, "site_id": "invalid"}]

    def drop_file(name, requests):
        (source / name).write_text("\n".join(json.dumps(r) for r in requests) + "\n")

    def run():
        args = (str(tmp_path / "out"), str(tmp_path / "progress"))
        start_scoring(spark, str(source), model, *args, "1.0.0").awaitTermination()
        refused = (str(tmp_path / "refused"), str(tmp_path / "refused-progress"))
        start_rejects(spark, str(source), *refused).awaitTermination()

    drop_file("a.json", good[:10] + bad)
    run()
    drop_file("b.json", good[10:])
    run()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("confidence_interval").collect()
    everything = ops.validate_requests(read_requests(spark, str(source)))
    batch = score_requests(ops.valid_requests(everything), model, "1.0.0")
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch.drop("confidence_interval").collect()))
    assert len(streamed) == 30
    assert ops.rejected_requests(everything).count() == 2
    assert spark.read.json(str(tmp_path / "refused")).count() == 2


@pytest.mark.parametrize(
    ("change", "rejects"),
    [
        ({"site_id": "7", "hour_of_day": 14.0}, []),  # numbers as text, whole numbers with a fraction of 0
        ({"site_id": "invalid"}, ["site_id"]),
        ({"hour_of_day": 4.5}, ["hour_of_day"]),
        ({"lag_1": "many"}, ["lag_1"]),  # optional, but not of any type
        ({"lag_24": [1]}, ["lag_24"]),
        ({"unknown": 1}, []),
    ],
)
def test_wrong_types_are_named_and_kept(spark, change, rejects):
    line = json.dumps({**SAMPLE, **change})
    row = ops.name_rules(ops.validate_requests(parse_requests(spark.createDataFrame([(line,), (" ",)], "value string"))))
    found = row.collect()
    assert len(found) == 1 and found[0]["rejects"] == rejects and found[0]["raw"] == line
    assert [r.split(":")[0] for r in found[0]["rules"]] == rejects


def test_lines_that_are_no_object_are_refused_whole(spark):
    lines = ["{", "[1]", '"text"', "{}"]
    rows = ops.validate_requests(parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    found = {r["raw"]: r for r in rows}
    assert set(found) == set(lines) and all(r["rejects"] for r in rows)
    assert "line" in found["{"]["rejects"] and "line" not in found["{}"]["rejects"]


def test_one_stream_answers_and_refuses_and_repeats_nothing(spark, model, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    places = [str(tmp_path / n) for n in ("answers", "refused", "progress")]
    good = [{**SAMPLE, "site_id": i} for i in range(1, 13)]
    bad = [{**SAMPLE, "site_id": 0}, {**SAMPLE, "site_id": "invalid"}]

    def drop_file(name, requests):
        (source / name).write_text("\n".join(json.dumps(r) for r in requests) + "\n")

    drop_file("a.json", good[:5] + bad)
    start_answering(spark, str(source), model, *places, "1.0.0").awaitTermination()
    # a crash after writing and before the commit: the same batch comes again
    answer_batch(read_requests(spark, str(source)), 0, model, *places[:2], "1.0.0")
    drop_file("b.json", good[5:])
    start_answering(spark, str(source), model, *places, "1.0.0").awaitTermination()
    start_answering(spark, str(source), model, *places, "1.0.0").awaitTermination()
    answers = spark.read.parquet(places[0])
    assert sorted(r["site_id"] for r in answers.collect()) == list(range(1, 13))
    refused = spark.read.parquet(places[1]).collect()
    assert sorted(r["raw"] for r in refused) == sorted(map(json.dumps, bad))
    assert {tuple(r["rejects"]) for r in refused} == {("site_id",)}
