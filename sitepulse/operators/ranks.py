"""Exact positions in a global order, with the sorting spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

_LOCAL_BITS = (1 << 33) - 1


def write_sorted(df: DataFrame, *order_by: str) -> DataFrame:
    """Sort with one range shuffle and keep each row's ``_task`` and ``_place`` in that task.

    Everything in a task comes before everything in the next one. The range boundaries come
    from a sample of the whole key, so a crowded hour, site or feature is spread over tasks.
    The result is written to the shared folder: whatever is derived from it sees the same tasks,
    also after an executor is lost, and the input is evaluated once. ``order_by`` has to
    identify a row.
    """
    placed = (
        df.orderBy(*order_by)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)))
    )
    return materialize(placed, "sorted")


def with_row_index(df: DataFrame, *order_by: str) -> DataFrame:
    """Add ``row_index`` (from 0) and ``row_total`` for the order given by ``order_by``.

    Only the task sizes are put in sequence: one row per shuffle partition, which also bounds
    the broadcast.
    """
    placed = write_sorted(df, *order_by)
    so_far = Window.orderBy("_task")
    offsets = (
        placed.groupBy("_task")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            "_task",
            (F.sum("_size").over(so_far) - F.col("_size")).alias("_offset"),
            F.sum("_size").over(Window.partitionBy()).alias("row_total"),
        )
    )
    return placed.join(F.broadcast(offsets), "_task").select(
        *df.columns, (F.col("_offset") + F.col("_place")).alias("row_index"), "row_total"
    )


def with_key_index(df: DataFrame, outer: Column, inner: Column, *order_by: str) -> DataFrame:
    """Add ``row_index`` (from 0) and ``row_total`` without a sort of all rows or a written copy.

    ``outer`` and, within it, ``inner`` cut the order of ``order_by`` into groups, whose sizes are counted
    first. Running sums of those give each group its offset, ``row_number`` the place inside it,
    so the rows are shuffled once, by group. One task puts the values of ``outer`` in sequence; ``inner`` is
    to keep groups small where many rows share ``outer``. Nulls come first. ``df`` is evaluated twice, and
    has to be deterministic; ``order_by`` has to identify a row.
    """
    # as structs, nulls are values like others in the join below
    keyed = df.withColumn("_outer", F.struct(outer.alias("k"))).withColumn("_inner", F.struct(inner.alias("k")))
    sizes = keyed.groupBy("_outer", "_inner").agg(F.count(F.lit(1)).alias("_size"))
    rows_before = F.sum("_rows").over(Window.orderBy("_outer")) - F.col("_rows")
    starts = (
        sizes.groupBy("_outer")
        .agg(F.sum("_size").alias("_rows"))
        .select(
            "_outer",
            rows_before.alias("_start"),
            F.sum("_rows").over(Window.partitionBy()).alias("row_total"),
        )
    )
    so_far = F.sum("_size").over(Window.partitionBy("_outer").orderBy("_inner")) - F.col("_size")
    offsets = sizes.join(starts, "_outer").select(
        "_outer", "_inner", (F.col("_start") + so_far).alias("_offset"), "row_total"
    )
    place = F.row_number().over(Window.partitionBy("_outer", "_inner").orderBy(*order_by)) - 1
    return (
        keyed.withColumn("_place", place)
        .join(offsets, ["_outer", "_inner"])
        .select(*df.columns, (F.col("_offset") + F.col("_place")).alias("row_index"), "row_total")
    )
