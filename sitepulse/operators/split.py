"""Training rows and their assignment to splits and folds.

Rows have one ``site_id`` and ``hour`` each. Splits evaluate their input twice, once for the sizes of key
groups; write an input that is costly first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults
from .ranks import with_key_index

INDEX, TOTAL = "row_index", "row_total"
TIME_ORDER = ("hour", "site_id")
SITE_ORDER = ("site_id", "hour")
SITES_IN_GROUP = 4096


def in_time_order(rows: DataFrame) -> DataFrame:
    """``row_index`` and ``row_total`` by hour and site, counted by hour and run of sites."""
    sites = F.floor(F.col("site_id") / SITES_IN_GROUP)
    return with_key_index(rows, F.col("hour"), sites, *TIME_ORDER)


def in_site_order(rows: DataFrame) -> DataFrame:
    """``row_index`` and ``row_total`` by site and hour, counted by site and month."""
    return with_key_index(rows, F.col("site_id"), F.date_trunc("month", "hour"), *SITE_ORDER)


def _three_way(n_test: Column, n_val: Column) -> Column:
    n_train = F.col(TOTAL) - n_test - n_val
    return (
        F.when(F.col(INDEX) < n_train, "train")
        .when(F.col(INDEX) < n_train + n_val, "validation")
        .otherwise("test")
    )


def time_split(
    rows: DataFrame,
    test_size: float = defaults.TEST_SIZE,
    validation_size: float = defaults.VALIDATION_SIZE,
) -> DataFrame:
    """Oldest rows to ``train``, then ``validation``, newest to ``test``; sizes round down."""
    share = [F.floor(F.col(TOTAL) * F.lit(s)) for s in (test_size, validation_size)]
    return in_time_order(rows).withColumn("split", _three_way(*share))


def random_split(
    rows: DataFrame,
    test_size: float = defaults.TEST_SIZE,
    validation_size: float = defaults.VALIDATION_SIZE,
    seed: int = defaults.RANDOM_STATE,
) -> DataFrame:
    """Exact split sizes with membership by a seeded hash of the row key; sizes round up.

    The validation share applies to what the test split leaves.
    """
    key = F.concat_ws("|", F.lit(str(seed)), "site_id", F.date_format("hour", "yyyy-MM-dd HH"))
    hashed = rows.withColumn("_hash", F.md5(key))
    n_test = F.ceil(F.col(TOTAL) * F.lit(test_size))
    n_val = F.ceil((F.col(TOTAL) - n_test) * F.lit(validation_size / (1 - test_size)))
    groups = F.substring("_hash", 1, 4), F.substring("_hash", 5, 1)
    indexed = with_key_index(hashed, *groups, "_hash", *TIME_ORDER)
    return indexed.withColumn("split", _three_way(n_test, n_val)).drop("_hash")


def baseline_split(rows: DataFrame, train_size: float = 0.9) -> DataFrame:
    """First part of the rows in site and hour order to ``train``, the rest to ``test``."""
    n_train = F.floor(F.col(TOTAL) * F.lit(train_size))
    return in_site_order(rows).withColumn(
        "split", F.when(F.col(INDEX) < n_train, "train").otherwise("test")
    )


def fold_bounds(fold: int, splits: int) -> tuple[Column, Column]:
    """First and one-past-last ``row_index`` that ``fold`` (from 0) tests on."""
    size = F.floor(F.col(TOTAL) / (splits + 1))
    start = F.col(TOTAL) - (splits - fold) * size
    return start, start + size


def fold_part(fold: int, splits: int) -> Column:
    """``train``, ``test`` or NULL (later than the fold) for an indexed row."""
    start, end = fold_bounds(fold, splits)
    return F.when(F.col(INDEX) < start, "train").when(F.col(INDEX) < end, "test")


def fold_summary(indexed: DataFrame, splits: int = defaults.CV_SPLITS) -> DataFrame:
    """Rows and test period of each expanding-window fold, from one pass over the rows."""
    parts = F.array(
        *[F.struct(F.lit(k).alias("fold"), fold_part(k, splits).alias("part")) for k in range(splits)]
    )
    tested = F.when(F.col("part") == "test", F.col("hour"))
    return (
        indexed.select("hour", F.explode(parts).alias("_f"))
        .select("hour", "_f.*")
        .groupBy("fold")
        .agg(
            F.count_if(F.col("part") == "train").alias("train_rows"),
            F.count_if(F.col("part") == "test").alias("test_rows"),
            F.min(tested).alias("test_start"),
            F.max(tested).alias("test_end"),
        )
    )
