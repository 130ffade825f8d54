from datetime import datetime, timedelta

import pytest

from sitepulse.operators import split
from sitepulse.operators.ranks import with_row_index

SCHEMA = "site_id bigint, hour timestamp_ntz, sessions double"


@pytest.fixture(scope="module")
def crowded(spark):
    """Most rows in one hour, some sites longer than others."""
    start = datetime(2024, 1, 1)
    rows = [(site, start + timedelta(hours=7), float(site)) for site in range(500)]
    rows += [(3, start + timedelta(hours=h), 1.0) for h in range(20) if h != 7]
    rows += [(9, start + timedelta(hours=h), 2.0) for h in range(8, 30)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize("order", [split.TIME_ORDER, split.SITE_ORDER])
def test_row_index_equals_the_global_order(spark, crowded, order):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexed = with_row_index(crowded, *order).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(indexed["row_total"]) == {len(indexed)} == {541}
    ranked = indexed.sort_values(list(order)).reset_index(drop=True)
    assert list(ranked["row_index"]) == list(range(541))


@pytest.mark.parametrize("index", [split.in_time_order, split.in_site_order])
def test_key_index_equals_the_global_order(spark, crowded, index, monkeypatch):
    monkeypatch.setattr(split, "SITES_IN_GROUP", 64)
    start = datetime(2024, 2, 1)
    odd = [(None, start, 0.0), (None, None, 0.0), (4, None, 0.0), (5, None, 0.0), (-70, start, 0.0), (4, start, 0.0)]
    rows = crowded.union(spark.createDataFrame(odd, SCHEMA))
    order = split.TIME_ORDER if index is split.in_time_order else split.SITE_ORDER
    got = [(tuple(r[c] for c in order), r.row_index, r.row_total) for r in index(rows).collect()]
    got.sort(key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r[0]])
    assert [r[1] for r in got] == list(range(547)) and {r[2] for r in got} == {547}
    assert index(rows.limit(0)).count() == 0


def test_splits_neither_sort_all_rows_nor_write_them(crowded, capsys):
    for divide in (split.time_split, split.random_split, split.baseline_split):
        divide(crowded).explain("formatted")
        plan = capsys.readouterr().out
        assert "rangepartitioning" not in plan and "parquet" not in plan.lower()


def test_a_crowded_hour_is_spread_over_tasks(spark, crowded):
    from sitepulse.operators.ranks import write_sorted

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in write_sorted(crowded, *split.TIME_ORDER).groupBy("_task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 250


def test_time_split_sizes_and_order(crowded):
    rows = split.time_split(crowded).toPandas()
    sizes = rows["split"].value_counts().to_dict()
    assert sizes == {"test": 108, "validation": 54, "train": 379}
    keys = {k: list(zip(g["hour"], g["site_id"])) for k, g in rows.groupby("split")}
    assert max(keys["train"]) < min(keys["validation"])
    assert max(keys["validation"]) < min(keys["test"])


def test_random_split_sizes_and_seed(crowded):
    def members(**kwargs):
        rows = split.random_split(crowded, **kwargs).toPandas()
        assert len(rows) == 541
        return {k: set(zip(g["hour"], g["site_id"])) for k, g in rows.groupby("split")}

    first, again, other = members(), members(), members(seed=1)
    assert {k: len(v) for k, v in first.items()} == {"test": 109, "validation": 54, "train": 378}
    assert first == again and first != other


def test_baseline_split(crowded):
    rows = split.baseline_split(crowded).toPandas()
    train = rows[rows["split"] == "train"]
    assert len(train) == 486
    assert max(zip(train["site_id"], train["hour"])) < min(
        (s, h) for s, h, p in zip(rows["site_id"], rows["hour"], rows["split"]) if p == "test"
    )


@pytest.mark.parametrize(("n", "k"), [(541, 5), (541, 3), (17, 4), (6, 5)])
def test_folds_expand(spark, n, k):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(hours=i), 1.0) for i in range(n)]
    indexed = with_row_index(spark.createDataFrame(rows, SCHEMA), *split.TIME_ORDER)
    folds = sorted(map(tuple, split.fold_summary(indexed, k).collect()))
    size = n // (k + 1)
    for fold, train, test, first, last in folds:
        begin = n - (k - fold) * size
        assert (train, test) == (begin, size)
        assert first == start + timedelta(hours=begin)
        assert last == start + timedelta(hours=begin + size - 1)
    assert folds[-1][1] + folds[-1][2] == n
