"""Sorted distributions split over many tasks: exact quantiles and their building block.

Equal values of a column are counted together first, so a value that fills a third of the rows
is one row afterwards. The counts are then sorted over all tasks; a task's share is the bucket
in which order statistics are looked up, and only bucket totals are put in sequence.

Quantiles need few of the values. A sketch (in the same pass as the caller's moments) brackets each wanted
rank; the second pass counts what lies between the brackets and keeps the distinct values inside.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .ranks import write_sorted

BUCKET = ("feature", "bucket")
SKETCH = 10_000  # accuracy of the sketch that brackets ranks


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def long_form(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``feature, value`` (and ``keep``) of the values that are there."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), columns, "feature", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def sorted_counts(long: DataFrame, *counts: Column) -> DataFrame:
    """``counts`` per ``feature`` and distinct ``value``, in ordered ``bucket`` pieces.

    Runs at once: the sorted counts are written, so the input is read a single time.
    """
    distinct = long.groupBy("feature", "value").agg(*counts)
    return (
        write_sorted(distinct, "feature", "value")
        .withColumnRenamed("_task", "bucket")
        .drop("_place")
    )


def brackets(probabilities: dict[str, float]) -> Column:
    """Aggregate over ``value``: lower and upper bounds of the wanted order statistics, in rank order.

    The sketch is off by one rank in ``SKETCH`` at most, so four are a safe distance, and two ranks more from
    ``SKETCH`` values on. Below that a bracket is the whole range.
    """
    slack = 4.0 / SKETCH
    shares = [min(max(p + d, 0.0), 1.0) for p in sorted(probabilities.values()) for d in (-slack, slack)]
    whole = F.array(*[F.min("value"), F.max("value")] * len(probabilities))
    return F.when(F.count("value") < SKETCH, whole).otherwise(F.percentile_approx("value", shares, SKETCH))


def _bracketed_counts(long: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """Counts per distinct value inside the ``n`` brackets of its feature and one count per gap.

    ``last`` of a gap is its largest value, so the order is that of the values, and ``is_value`` is false.
    """
    value = F.col("value")
    ends = [(F.col("bounds")[2 * i], F.col("bounds")[2 * i + 1]) for i in range(n)]
    inside = reduce(or_, [value.between(low, high) for low, high in ends])
    gap = sum(((value > high).cast("int") for _, high in ends), F.lit(0))
    keys = [gap.alias("gap"), F.when(inside, value).alias("exact")]
    # One row of bounds per column.
    counted = long.join(F.broadcast(bounds), "feature").groupBy("feature", *keys)
    return counted.agg(F.max("value").alias("last"), F.count(F.lit(1)).alias("ties")).select(
        "feature", F.col("last").alias("value"), "ties", F.col("exact").isNotNull().alias("is_value")
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: dict[str, float],
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per column with the linearly interpolated quantiles, named by ``probabilities``.

    ``bounds`` (``feature, bounds``) are the ``brackets`` of the columns, if the caller has them from a pass of
    its own.
    """
    long = long_form(df, columns)
    if bounds is None:
        bounds = long.groupBy("feature").agg(brackets(probabilities).alias("bounds"))
    few = _bracketed_counts(long, bounds, len(probabilities))
    counts = (
        write_sorted(few, "feature", "value").withColumnRenamed("_task", "bucket").drop("_place")
    )

    # Which bucket holds each wanted rank: one row per column and bucket is enough to tell.
    by_bucket = Window.partitionBy("feature").orderBy("bucket")
    sizes = counts.groupBy(*BUCKET).agg(F.sum("ties").alias("size"))
    spans = sizes.select(
        *BUCKET,
        "size",
        (F.sum("size").over(by_bucket) - F.col("size")).alias("before"),
        F.sum("size").over(Window.partitionBy("feature")).alias("total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("position"))
            for name, p in probabilities.items()
        ]
    )
    targets = (
        spans.select("*", F.explode(wanted).alias("_w"))
        .select(
            *BUCKET,
            "size",
            "before",
            "_w.name",
            (F.col("_w.position") - F.floor("_w.position")).alias("fraction"),
            F.explode(
                F.array_distinct(F.array(F.floor("_w.position"), F.ceil("_w.position")))
            ).alias("rank"),
            F.floor("_w.position").alias("lower_rank"),
        )
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
        .select(
            *BUCKET,
            "name",
            "fraction",
            (F.col("rank") == F.col("lower_rank")).alias("is_lower"),
            (F.col("rank") - F.col("before")).alias("local_rank"),
        )
    )
    # At most two target rows per column and probability; only their buckets are sorted again.
    up_to = Window.partitionBy(*BUCKET).orderBy("value")
    buckets = F.broadcast(targets.select(*BUCKET).distinct())
    placed = counts.join(buckets, list(BUCKET), "left_semi").withColumn(
        "last", F.sum("ties").over(up_to)
    )
    hits = placed.join(F.broadcast(targets), list(BUCKET)).filter(
        (F.col("local_rank") < F.col("last")) & (F.col("local_rank") >= F.col("last") - F.col("ties"))
    )
    # a rank outside its bracket would be an error of the sketch: no result rather than a wrong one
    value = F.when(F.col("is_value"), F.col("value")).otherwise(
        F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    )
    hits = hits.withColumn("value", value)
    lower = F.max(F.when(F.col("is_lower"), F.col("value")))
    upper = F.max(F.when(~F.col("is_lower"), F.col("value")))
    quantile = lower + F.coalesce((upper - lower) * F.max("fraction"), F.lit(0.0))
    found = hits.groupBy("feature", "name").agg(quantile.alias("quantile"))
    return found.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("name") == name, F.col("quantile"))).alias(name)
            for name in probabilities
        ]
    )
