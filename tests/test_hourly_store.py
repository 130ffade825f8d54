from datetime import date, datetime, timedelta

import pytest
from conftest import SESSIONS
from pyspark.sql import functions as F

from sitepulse.operators import rollups
from sitepulse.operators.hourly import aggregate_hourly
from sitepulse.sources import hourly_store

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (i % 4 + 1, START + timedelta(minutes=37 * i), None if i % 11 == 0 else float(i % 13)) for i in range(240)
    ]
    return spark.createDataFrame(rows, SESSIONS)


@pytest.fixture(scope="module")
def store(log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    for number in (0, 1, 2, 1):  # batch 1 comes twice
        hourly_store.add_batch(log.filter(F.minute("timestamp") % 3 == number), path, str(number))
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_add_up_to_the_table(spark, log, store):
    assert rows_of(hourly_store.read_hourly(spark, store)) == rows_of(aggregate_hourly(log))


def test_days_are_read_from_their_folders(spark, log, store):
    start, end = date(2024, 3, 2), date(2024, 3, 3)
    found = hourly_store.read_hourly(spark, store, start, end)
    assert rows_of(found) == rows_of(aggregate_hourly(log, start, end))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_overview_reads_two_days(spark, log, store):
    found = hourly_store.stored_overview(spark, store)
    assert rows_of(found) == rows_of(rollups.overview_metrics(aggregate_hourly(log)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_a_batch_writes_only_its_days(spark, log, tmp_path):
    path = str(tmp_path)
    hourly_store.add_batch(log, path, "first")
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "hours").rglob("*.parquet")}
    late = log.filter("timestamp < TIMESTAMP_NTZ '2024-03-01 05:00:00'")
    hourly_store.add_batch(late, path, "late")
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "hours").rglob("*.parquet")}
    assert before.items() <= after.items()
    assert {f.parent.parent.name for f in (tmp_path / "hours").rglob("*.parquet") if f.name not in before} == {"date=2024-03-01"}


def test_empty_batch(spark, log, tmp_path):
    hourly_store.add_batch(log.limit(0), str(tmp_path), "none")
    hourly_store.add_batch(log, str(tmp_path), "all")
    assert hourly_store.read_hourly(spark, str(tmp_path)).count() == aggregate_hourly(log).count()
    assert hourly_store.latest_date(spark, str(tmp_path)) == date(2024, 3, 7)
