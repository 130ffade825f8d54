"""Word positions and hashes of whole Arrow batches, computed on the UTF-8 bytes with numpy.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over random values of its
bytes modulo 2**64, taken from prefix sums, so that its cost does not depend on the word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xC2B2AE3D27D4EB4F
_UNSTEP = pow(_STEP, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED = BYTE_VALUES.copy()
FOLDED[65:91] = FOLDED[97:123]
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False



class _Tables(dict):
    """Kept per process, and left out when the module travels to executors."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, because texts may be long. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of bounded size."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def releasing(fn):
    """``fn`` for one task, after which memory that is no longer used goes back to the system.

    Python workers serve many tasks; what one of them keeps after large arrays is lacking elsewhere.
    """

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, .. modulo 2**64; kept for the next call."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Consecutive rows ``first..first+len(starts)`` of a batch; offsets are into ``buf``."""

    first: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into row runs of about ``limit`` bytes; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        at = offsets[row : stop + 1] - offsets[row]
        yield Chunk(row, buf[offsets[row] : offsets[stop]], at[:-1], at[1:])
        row = stop


@dataclass
class Words:
    """Words of a chunk in order; ``first[d]:first[d + 1]`` are those of its document d."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def find_words(chunk: Chunk, values: np.ndarray = BYTE_VALUES) -> Words:
    """Word bounds and 64-bit hashes; ``FOLDED`` as ``values`` ignores the case of A-Z."""
    buf, n = chunk.buf, len(chunk.buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[buf]
    cut = np.zeros(n + 1, bool)
    cut[chunk.starts] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    cut[n] = True
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    first = np.append(np.searchsorted(begin, chunk.starts), len(begin))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * powers(_INVERSE, n + 1)[begin])
    return Words(begin, end, first, hashes)


def window_hashes(word_hash: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ``width`` consecutive words from each position (or from ``at``).

    Windows that reach over the end of a document have to be left out by the caller.
    """
    n = len(word_hash)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * powers(_STEP, n), out=sums[1:])
    if at is None:
        at = np.arange(n - width + 1)
    return mix((sums[at + width] - sums[at]) * powers(_UNSTEP, n + 1)[at] + np.uint64(width))
