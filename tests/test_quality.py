from datetime import datetime, timedelta

import pytest
from conftest import SESSIONS, START
from pyspark.sql import Observation

from sitepulse.operators import quality
from sitepulse.sources.sessions import load_sessions, prepare_sessions, unreadable_sessions


def test_empty_input_is_an_error(spark):
    with pytest.raises(quality.DataValidationError, match="empty"):
        quality.validate_data(spark.createDataFrame([], SESSIONS))


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1, "2024-01-01")], "site_id int, timestamp string")
    with pytest.raises(quality.DataValidationError, match="Missing required columns"):
        quality.validate_data(df)


@pytest.mark.parametrize(
    ("schema", "row", "message"),
    [
        ("site_id string, timestamp string, sessions double", ("a", "x", 1.0), "site_id must be"),
        ("site_id int, timestamp string, sessions string", (1, "x", "a"), "sessions must be"),
    ],
)
def test_non_numeric_column_is_an_error(spark, schema, row, message):
    with pytest.raises(quality.DataValidationError, match=message):
        quality.validate_data(spark.createDataFrame([row], schema))


def test_report_counts_nulls_and_negatives(spark):
    rows = [(1, START, -1.0), (1, None, 2.0), (None, START, None)]
    report = quality.validation_report(spark.createDataFrame(rows, SESSIONS)).first().asDict()
    assert report == {
        "total_rows": 3,
        "null_site_id": 1,
        "null_timestamp": 1,
        "null_sessions": 1,
        "negative_sessions": 1,
    }


def test_clean_keeps_the_first_copy_and_clips(spark, raw_rows):
    rows = [(*r, i) for i, r in enumerate(raw_rows)]
    copies = [(*raw_rows[0], 60), (*raw_rows[1], 61)]
    rows[0] = (*rows[0][:2], -1.0, 0)
    df = spark.createDataFrame(rows + copies, SESSIONS + ", line bigint")
    clean = quality.sorted_for_output(quality.clean_data(df, order_by=("line",))).collect()
    assert len(clean) == 60
    assert clean[0]["sessions"] == 0.0
    keys = [(r["site_id"], r["timestamp"]) for r in clean]
    assert keys == sorted(keys)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "sessions double")
    assert [r[0] for r in quality.clip_negative(df).collect()] == [None, 0.0, 3.0]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rows = spark.range(3000).selectExpr(
        "if(id < 2500, 1, id) AS site_id", "timestamp_ntz'2024-01-01' AS timestamp",
        "cast(id AS double) AS sessions", "id AS line",
    )
    kept = quality.deduplicate(rows, order_by=("line",))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[1]
    assert kept.count() == 501
    assert kept.filter("site_id = 1").first()["sessions"] == 0.0


def test_csv_load(spark, tmp_path, raw_rows):
    lines = ["timestamp,sessions,site_id"]
    lines += [f"{t.isoformat()},{v},{s}" for s, t, v in raw_rows]
    lines += [f"{raw_rows[3][1].isoformat()},99.0,{raw_rows[3][0]}", "2024-02-01T00:00:00,-4,99"]
    path = tmp_path / "sessions.csv"
    path.write_text("\n".join(lines) + "\n")
    seen = Observation("load")
    df = load_sessions(spark, str(path), observation=seen)
    rows = {(r["site_id"], r["timestamp"]): r for r in df.collect()}
    assert df.columns == ["site_id", "timestamp", "sessions", "state"]
    assert len(rows) == 61
    assert rows[raw_rows[3][:2]]["sessions"] == raw_rows[3][2]
    assert rows[(99, datetime(2024, 2, 1))].asDict()["state"] == "Unknown"
    assert rows[(99, datetime(2024, 2, 1))]["sessions"] == 0.0
    assert seen.get["total_rows"] == 62 and seen.get["negative_sessions"] == 1


BAD_CSV = """site_id,timestamp,sessions
1,2024-01-01T00:00:00,many
1,2024-01-01T01:00:00,5
1,2024-01-01T01:00:00,6
x,2024-13-01T01:00:00,7
2,2024-01-01T02:00:00
,2024-01-01T03:00:00,
"""


def test_csv_rows_that_cannot_be_read_are_set_aside(spark, tmp_path, caplog):
    path = tmp_path / "bad.csv"
    path.write_text(BAD_CSV)
    seen = Observation("bad")
    with caplog.at_level("WARNING"):
        df = load_sessions(spark, str(path), observation=seen, log_findings=True)
    rows = [(r["site_id"], r["sessions"]) for r in df.orderBy("site_id").collect()]
    assert rows == [(None, None), (1, 5.0)]  # missing values are not unreadable
    assert seen.get["unreadable_rows"] == 3 and seen.get["total_rows"] == 6
    found = {tuple(r["columns"]): r["text"] for r in unreadable_sessions(spark, str(path)).collect()}
    assert found == {
        ("sessions",): "1,2024-01-01T00:00:00,many",
        ("site_id", "timestamp"): "x,2024-13-01T01:00:00,7",
        ("line",): "2,2024-01-01T02:00:00",
    }
    assert "3 rows hold values" in caplog.text and "Missing values" in caplog.text


@pytest.mark.parametrize("name", ["site_id", "sessions"])
def test_csv_column_without_a_number_is_an_error(spark, tmp_path, name):
    path = tmp_path / "text.csv"
    values = {"site_id": "1", "sessions": "2"} | {name: "abc"}
    path.write_text(f"site_id,timestamp,sessions\n{values['site_id']},2024-01-01T00:00:00,{values['sessions']}\n")
    with pytest.raises(quality.DataValidationError, match=f"{name} must be numeric"):
        load_sessions(spark, str(path))


def test_warnings_name_sites_without_a_state(spark, tmp_path, caplog):
    path = tmp_path / "sites.csv"
    path.write_text("site_id,timestamp,sessions\n99,2024-01-01T00:00:00,-1\n1,2024-01-01T00:00:00,1\n")
    with caplog.at_level("WARNING"):
        load_sessions(spark, str(path), log_findings=True)
    assert "[99]" in caplog.text and "1 rows count less than zero" in caplog.text


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "sessions")
    spark.createDataFrame([(1, START, 1.0)], SESSIONS).write.parquet(path)
    chosen = load_sessions(spark, path, "parquet").filter("site_id = 1 AND timestamp >= TIMESTAMP_NTZ '2024-01-01'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(site_id,1)" in pushed and "GreaterThanOrEqual(timestamp" in pushed


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_sessions(spark, str(tmp_path / "absent.csv"))


def test_parquet_load_takes_the_first_copy_in_the_file(spark, tmp_path):
    rows = [(1, START, float(i)) for i in range(20)] + [(2, START + timedelta(hours=1), 5.0)]
    path = str(tmp_path / "sessions")
    spark.createDataFrame(rows, SESSIONS).coalesce(1).write.parquet(path)
    got = load_sessions(spark, path, "parquet").orderBy("site_id").collect()
    assert [r["sessions"] for r in got] == [0.0, 5.0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, START, float("nan"))], SESSIONS)
    assert prepare_sessions(df, ("sessions",)).first()["sessions"] is None
    with pytest.raises(ValueError):
        prepare_sessions(df)


def test_files_with_other_column_orders_are_refused(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.csv").write_text("site_id,timestamp,sessions\n1,2024-01-01 00:00:00,5\n")
    (folder / "b.csv").write_text("sessions,timestamp,site_id\n7,2024-01-01 00:00:00,2\n")
    with pytest.raises(Exception, match="header"):
        load_sessions(spark, str(folder)).collect()
