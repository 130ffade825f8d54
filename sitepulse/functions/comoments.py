"""Correlations of many columns from mergeable blocks of co-moments.

A task reduces its rows to one block: for every two columns, over the rows that have both, the number
of rows, the means, the sums of squared and mixed deviations and the range. Blocks are
merged like means are (no raw sums, so nothing cancels), in groups of ``MERGED`` first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Send this module by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MERGED = 64  # blocks that one task merges before the last step
PARTS = 6  # count, mean, squared deviations, mixed deviations, least, greatest: of x, rows with x and y


def block_of(values: np.ndarray) -> np.ndarray:
    """The block of rows of numbers; NaN is missing. ``[part, x, y]``; x is seen in the rows that have y."""
    there = ~np.isnan(values)
    has = there.astype(float)
    count = has.T @ has
    with np.errstate(invalid="ignore", divide="ignore"):
        # deviations from the column mean first, so that the correction for the pair's own mean is small
        middle = np.where(there.any(axis=0), np.nansum(values, axis=0) / has.sum(axis=0), 0.0)
        gaps = np.where(there, values - middle, 0.0)
        shift = np.where(count > 0, gaps.T @ has / count, 0.0)
    squared = (gaps**2).T @ has - count * shift**2
    mixed = gaps.T @ gaps - count * shift * shift.T
    low = np.array([np.where(there[:, [y]] & there, values, np.inf).min(axis=0) for y in range(values.shape[1])]).T
    high = np.array([np.where(there[:, [y]] & there, values, -np.inf).max(axis=0) for y in range(values.shape[1])]).T
    return np.stack([count, middle[:, None] + shift, np.maximum(squared, 0), mixed, low, high])


def merge_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The block of the rows of both."""
    count = a[0] + b[0]
    share = np.divide(b[0], count, out=np.zeros_like(count), where=count > 0)
    gap = np.where(a[0] > 0, np.where(b[0] > 0, b[1] - a[1], 0.0), 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    weight = a[0] * share
    squared = a[2] + b[2] + weight * gap**2
    mixed = a[3] + b[3] + weight * gap * gap.T
    return np.stack([count, mean, squared, mixed, np.minimum(a[4], b[4]), np.maximum(a[5], b[5])])


def correlations_of(block: np.ndarray) -> np.ndarray:
    """Pearson's r of every two columns; NaN where a column is constant or fewer than two rows have both."""
    varies = block[5] > block[4]
    with np.errstate(invalid="ignore", divide="ignore"):
        r = block[3] / np.sqrt(block[2] * block[2].T)
    return np.where(varies & varies.T, np.clip(r, -1, 1), np.nan)


def pair_correlations(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """``a, b, correlation`` for pairs of places in ``columns``, in one pass; no rows where there are none."""
    k = len(columns)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                values = [np.asarray(c.fill_null(np.nan)) for c in batch.columns]
                block = block_of(np.stack(values, axis=1))
                total = block if total is None else merge_blocks(total, block)
        if total is not None:
            part = TaskContext.get().partitionId() // MERGED
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()])], ["part", "block"])

    def merged(table: pa.Table) -> np.ndarray:
        total = None
        for blob in table["block"].to_pylist():
            block = np.frombuffer(blob).reshape(PARTS, k, k)
            total = block if total is None else merge_blocks(total, block)
        return total

    def merge(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([0]), pa.array([merged(table).tobytes()])], ["part", "block"])

    def finish(table: pa.Table) -> pa.Table:
        r = correlations_of(merged(table))
        a, b = (pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1))
        found = np.array([r[p] for p in pairs], float)
        return pa.table([a, b, pa.array(found, mask=np.isnan(found))], ["a", "b", "correlation"])

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    blocks = numbers.mapInArrow(reduce_rows, "part long, block binary")
    fewer = blocks.groupBy("part").applyInArrow(merge, "part long, block binary")
    return fewer.groupBy("part").applyInArrow(finish, "a int, b int, correlation double")
