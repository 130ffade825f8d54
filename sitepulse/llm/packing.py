"""Texts as small compressed blobs, for shuffles that have to carry them."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .textbatch import map_batches


def pack_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text as one zstandard frame each (null becomes empty).

    A frame is about half of what Spark's own shuffle compression makes of the text.
    """

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, texts = batch.columns
            blobs = [squeeze(t.as_buffer()) if t.is_valid else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return map_batches(df.select("doc_id", text_col), pack, "doc_id long, blob binary")


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob) if blob else b""


def unpack_column(blobs: pa.Array) -> pa.Array:
    return pa.array([unpack(b) for b in blobs.to_pylist()], pa.binary()).cast(
        pa.large_string()
    )
