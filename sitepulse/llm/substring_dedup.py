"""Removal of repeated passages, found with difference-cover anchors.

A passage is ``WINDOW`` consecutive words. ``COVER`` is a difference cover modulo ``PERIOD``: for
any two positions some offset below ``PERIOD`` takes both to cover positions. So two equal
passages, wherever they start, share an anchor (``WINDOW - PERIOD + 1`` words) that starts at a
cover position of both documents. Only such anchors, a fifth of all positions, are hashed and
compared over the corpus. Then the matches are extended: where a document has an anchor in common
with another one, all whole passages around it are hashed, and those that also start in a
document with a smaller ``doc_id`` are removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .packing import pack_texts, unpack, unpack_column
from .textbatch import find_words, map_batches, text_chunks, window_hashes

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
PAIRS = "key long, doc_id long"


def _flat(keys: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
    ids = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
    flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids)], ["key", "doc_id"])


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, doc_id``: hashes of the anchors at cover positions, each once per document."""
    width = window - PERIOD + 1
    cover = np.array(COVER)

    def hash_anchors(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in text_chunks(batch.column(1)):
                words = find_words(chunk)
                sizes = np.diff(words.first)
                keys, owners = [], []
                at, bounds = [], [0]
                for d in np.flatnonzero(sizes >= window):
                    n = sizes[d] - width + 1
                    grid = (np.arange(0, n, PERIOD)[:, None] + cover).ravel()
                    grid = grid[grid < n] + words.first[d]
                    at.append(grid)
                    bounds.append(bounds[-1] + len(grid))
                    owners.append(int(ids[chunk.first + d]))
                if not at:
                    continue
                hashes = window_hashes(words.hash, width, np.concatenate(at))
                keys = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield _flat(keys, owners)

    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_batches(rows.select("doc_id", "text"), hash_anchors, PAIRS)


def common_anchors(pairs: DataFrame) -> DataFrame:
    """Per document the anchors that other documents have too.

    One range shuffle by key and document puts equal keys next to each other, and spreads a
    key that fills more than one task. A key at the edge of a task counts as common, which may
    add a few passages to look at and never loses one.
    """

    def runs(batches):
        last_key = last_doc = None
        many = edge = True
        for batch in batches:
            key = batch.column(0).to_numpy()
            doc = batch.column(1).to_numpy()
            if not len(key):
                continue
            if last_key is not None:  # the row held back, in front
                key, doc = np.append(last_key, key), np.append(last_doc, doc)
            new = np.append(True, key[1:] != key[:-1])
            alone = new & np.append(new[1:], True)
            if last_key is not None and (many or edge):
                alone[0] = False
            if last_key is None:
                alone[0] = False
            many = not new[-1] or (len(key) == 1 and last_key is not None and many)
            edge = len(key) == 1
            last_key, last_doc = key[-1], doc[-1]
            keep = ~alone[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:-1][keep]), pa.array(doc[:-1][keep])], ["key", "doc_id"]
            )
        if last_key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last_key]), pa.array([last_doc])], ["key", "doc_id"]
            )

    ordered = pairs.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    common = ordered.mapInArrow(runs, PAIRS)
    return common.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def passages(packed: DataFrame, common: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, doc_id``: hashes of the whole passages that contain a common anchor."""
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def extend(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, wanted = unpack_column(batch.column(1)), batch.column(2)
            for chunk in text_chunks(texts):
                words = find_words(chunk)
                keys, owners = [], []
                for d in range(len(chunk.starts)):
                    mine = words.hash[words.first[d] : words.first[d + 1]]
                    n = len(mine) - window + 1
                    if n < 1:
                        continue
                    row = chunk.first + d
                    shared = np.asarray(wanted[row].values).view(np.uint64)
                    at = np.flatnonzero(np.resize(cover, len(mine) - width + 1))
                    at = at[np.isin(window_hashes(mine, width, at), shared)]
                    turn = np.zeros(len(mine) + 1, np.int64)
                    np.add.at(turn, np.maximum(at - PERIOD + 1, 0), 1)
                    np.add.at(turn, at + 1, -1)
                    starts = np.flatnonzero(np.cumsum(turn)[:n])
                    if len(starts):
                        keys.append(np.unique(window_hashes(mine, window, starts)))
                        owners.append(ids[row])
                yield _flat(keys, owners)

    rows = packed.join(common.hint("shuffle_hash"), "doc_id").select("doc_id", "blob", "keys")
    return map_batches(rows, extend, PAIRS)


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs`` (``doc_id, text``).

    A word goes if a passage that covers it also starts in a document with a smaller ``doc_id``,
    judged on the input. Null text has no words; a null ``doc_id`` is compared with nothing and
    loses nothing; rows with the same ``doc_id`` do not count as repeats of each other; a document
    of fewer than ``window`` words stays whole; passages repeated within one document stay.
    Other columns are ignored. ``window`` must be at least ``PERIOD``. Hashes have 64 bits.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = materialize(common_anchors(anchors(docs, window)), "anchors")
    packed = pack_texts(docs)
    found = passages(packed, common, window)
    first = (
        found.groupBy("key")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
    )
    repeats = found.join(first.select("key", "low"), "key").filter("doc_id > low")
    removed = repeats.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def cut(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for blob, keys in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = unpack(blob)
                words = raw.split()  # at the six ASCII white space bytes
                counts.append(len(words))
                if keys.is_valid:
                    (chunk,) = text_chunks(pa.array([raw], pa.binary()).cast(pa.large_string()))
                    hashes = window_hashes(find_words(chunk).hash, window)
                    starts = np.flatnonzero(np.isin(hashes, np.asarray(keys.values).view(np.uint64)))
                    turn = np.zeros(len(words) + 1, np.int64)
                    turn[starts] += 1
                    turn[starts + window] -= 1
                    words = list(compress(words, np.cumsum(turn)[:-1] == 0))
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    rows = packed.join(removed.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "blob", "keys")
    return map_batches(rows, cut, "doc_id long, n_words long, n_removed long, kept_text string")


def q_op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_passages(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLES = {
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
