"""Text quality by compression.

One zstandard dictionary is trained on good and one on bad labelled texts. A text like the good
ones compresses better with the good dictionary; the difference of the two sizes, divided by the
length, and the better of the two rates become a score by logistic calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, sample_ids
from .textbatch import map_batches

SAMPLE_DOCS = 2000  # labelled documents per label that are learned from
SAMPLE_BYTES = 32 << 20  # and at most as many bytes per label
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]
    centre: list[float]
    spread: list[float]
    prior: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = None
    if dictionary:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=data,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def _features(texts: list[bytes], good, bad) -> np.ndarray:
    size = np.array([len(t) for t in texts], float)
    g = np.array([len(good.compress(t)) for t in texts], float)
    b = np.array([len(bad.compress(t)) for t in texts], float)
    n = np.maximum(size, 1)
    least = np.minimum(g, b) / n
    gap = (b - g) / n
    return np.stack([gap, (b - g) / np.maximum(g, b), least, least**2, gap * least, 1 / n], 1)


def _train_dictionary(texts: list[bytes]) -> bytes:
    """Empty if the texts are too few or too short for a dictionary."""
    size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 4)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty + 1e-9)
        w -= np.linalg.solve(curve, x.T @ (p - y) + penalty * w)
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Learn from at most ``sample_docs`` documents (and ``SAMPLE_BYTES`` bytes) per label.

    Only rows outside ``held_out`` with one undisputed label 0 or 1 and a text count. Two thirds of
    the sample make the dictionaries, the rest calibrates. Without texts of both labels every
    score is the share of good labels (0.5 without any).
    """
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
    known = known.filter("quality = high").select("doc_id", "quality")
    chosen = sample_ids(known, "quality", sample_docs)  # bounded by the parameter, so broadcast
    texts = docs.filter("text <> ''").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "quality").toLocalIterator()
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    room = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}
    for text, quality in rows:
        raw = text.encode()
        if len(raw) <= room[quality]:
            room[quality] -= len(raw)
            by_label[quality].append(raw)
    shares = known.filter(~held_out()).agg(F.avg("quality")).first()[0]
    prior = 0.5 if shares is None else float(shares)
    cut = {q: len(t) * 2 // 3 for q, t in by_label.items()}
    if min(len(by_label[q]) - cut[q] for q in (0, 1)) < 1:
        return QualityModel(b"", b"", [], [], [], prior)
    good, bad = (_train_dictionary(by_label[q][: cut[q]]) for q in (1, 0))
    rest = [(t, q) for q in (0, 1) for t in by_label[q][cut[q] :]]
    x = _features([t for t, _ in rest], _compressor(good), _compressor(bad))
    y = np.array([q for _, q in rest], float)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    weights = _logistic((x - centre) / spread, y)
    # the sample has as many of each label as it can; move the intercept to the shares of all
    inside = min(max(y.mean(), 1e-6), 1 - 1e-6)
    outside = min(max(prior, 1e-6), 1 - 1e-6)
    weights[-1] += np.log(outside / (1 - outside)) - np.log(inside / (1 - inside))
    return QualityModel(good, bad, weights.tolist(), centre.tolist(), spread.tolist(), prior)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Only the text enters the score. Null counts as empty; an empty text gets the share of good
    labels as its score. Other columns are ignored; repeated rows are scored alike.
    """

    def score(batches):
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            texts = [t.as_py().encode() if t.is_valid else b"" for t in batch.column(1)]
            out = np.full(len(texts), model.prior)
            if model.weights and texts:
                x = (_features(texts, good, bad) - model.centre) / model.spread
                z = x @ np.array(model.weights[:-1]) + model.weights[-1]
                full = np.array([len(t) > 0 for t in texts])
                out = np.where(full, 1 / (1 + np.exp(-np.clip(z, -30, 30))), out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_batches(rows, score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def q_op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_quality(docs, labels))
