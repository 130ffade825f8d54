"""Which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPARE = 4  # ids that are ranked for each one that is kept


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4 (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample_ids(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """``doc_id, label``: at most ``per_label`` ids for each label, those with the smallest hashes.

    A sketch counts the ids of each label, and only ids whose hash lies below a bound that ``SPARE``
    times ``per_label`` ids are expected to meet are ranked. So a label's ranks need one task of a size that does
    not grow with the rows. Repeated rows count once; an id may stand under several labels.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.select("doc_id", label)
    sizes = rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("_ids"))  # a row per label
    share = F.least(F.lit(1.0), F.lit(float(SPARE * per_label)) / F.col("_ids"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    near = rows.join(F.broadcast(sizes), label).filter(place < share).select("doc_id", label).distinct()
    order = Window.partitionBy(label).orderBy(place, "doc_id")
    ranked = near.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= per_label).drop("_rank")
