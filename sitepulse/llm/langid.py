"""Language of a text by known words, with backoff to shorter and shorter character n-grams.

A word seen in training scores each language by its log frequency there. An unseen word is scored by
its known character n-grams of the greatest length, from ``LONGEST`` down to 1, that has any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import held_out, sample_ids
from .textbatch import map_batches, mix, powers, releasing

SAMPLE_DOCS = 800  # documents per language that are learned from
VOCABULARY = 20_000  # most frequent words, and n-grams of each length, kept per language
LONGEST = 4
UNDETERMINED = "und"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19


def _letter_bits() -> bytes:
    letters = [chr(c).isalpha() for c in range(0x110000)]
    return np.packbits(np.array(letters)).tobytes()


def _letters(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


class _Words:
    """Letter runs of some lower-cased texts, with hashes of any part of them."""

    def __init__(self, texts: list[str], letters: np.ndarray):
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, np.uint32)
        starts = np.cumsum([0] + [len(t) + 1 for t in lowered])[:-1]
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = letters[codes]
        self.begin = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.doc = np.searchsorted(starts, self.begin, side="right") - 1
        values = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(codes)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(codes) + 1)

    def hash(self, begin, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])

    def grams(self, begin, end, n: int):
        """Hashes of all n-grams of the given words, and which word each belongs to."""
        count = np.maximum(end - begin - n + 1, 0)
        word = np.repeat(np.arange(len(begin)), count)
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) - first[word] + begin[word]
        return self.hash(at, at + n), word


def _text_runs(column: pa.Array):
    """Rows of a string column in runs of about ``_CHUNK`` characters; null counts as empty."""
    run, size, first = [], 0, 0
    for row, text in enumerate(column.to_pylist()):
        run.append(text or "")
        size += len(run[-1])
        if size >= _CHUNK:
            yield first, run
            run, size, first = [], 0, row + 1
    if run:
        yield first, run


@dataclass
class LanguageModel:
    """Per level (0: words, n: n-grams) sorted hashes and their log frequency per language."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    letters: bytes


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> LanguageModel:
    """Learn from at most ``sample_docs`` documents per language outside ``held_out``.

    Counting is a Spark aggregation; the model keeps ``vocabulary`` entries per language and level,
    so its size is bounded by the number of languages.
    """
    letter_bits = _letter_bits()
    chosen = sample_ids(docs.filter("text IS NOT NULL"), "lang", sample_docs)
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    texts = rows.select("lang", "text")

    def count(batches):
        letters = _letters(letter_bits)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, run in _text_runs(batch.column(1)):
                words = _Words(run, letters)
                lang = langs[first + words.doc]
                for level in range(LONGEST + 1):
                    if level:
                        keys, word = words.grams(words.begin, words.end, level)
                    else:
                        keys, word = words.hash(words.begin, words.end), np.arange(len(words.begin))
                    for name in set(langs[first : first + len(run)]):
                        key, n = np.unique(keys[lang[word] == name], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(key), pa.string()),
                                pa.array(np.full(len(key), level, np.int32)),
                                pa.array(key.view(np.int64)),
                                pa.array(n.astype(np.int64)),
                            ],
                            ["lang", "level", "key", "n"],
                        )

    counted = map_batches(texts, releasing(count), "lang string, level int, key long, n long")
    counted = counted.groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY lang, level ORDER BY n DESC, key)")
    )
    rows = ranked.filter(F.col("rank") <= vocabulary).drop("rank").toPandas()
    languages = sorted(rows["lang"].unique())
    keys, scores = {}, {}
    for level in range(LONGEST + 1):
        part = rows[rows["level"] == level]
        keys[level] = np.unique(part["key"].to_numpy(np.int64).view(np.uint64))
        counts = np.zeros((len(keys[level]), len(languages)))
        at = np.searchsorted(keys[level], part["key"].to_numpy(np.int64).view(np.uint64))
        counts[at, np.searchsorted(languages, part["lang"].to_numpy(str))] = part["n"]
        scores[level] = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(keys[level]) + 1))
    return LanguageModel(languages, keys, scores, letter_bits)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in the sorted keys, -1 where it is absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _word_scores(model: LanguageModel, words: _Words, begin, end) -> np.ndarray:
    """Log frequency per language of each word; zero where nothing of it is known."""
    at = _find(model.keys[0], words.hash(begin, end))
    out = np.zeros((len(begin), len(model.languages)))
    out[at >= 0] = model.scores[0][at[at >= 0]]
    rest = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(rest):
            break
        grams, word = words.grams(begin[rest], end[rest], n)
        at = _find(model.keys[n], grams)
        word, at = word[at >= 0], at[at >= 0]
        hits = np.bincount(word, minlength=len(rest))
        for column in range(out.shape[1]):
            total = np.bincount(word, model.scores[n][at, column], minlength=len(rest))
            out[rest, column] = np.where(hits > 0, total / np.maximum(hits, 1), 0)
        rest = rest[hits == 0]
    return out


def add_language(
    docs: DataFrame, model: LanguageModel, name_col: str = "lang_pred", score_col: str = "lang_score"
) -> DataFrame:
    """``docs`` with the language of each ``text`` and the posterior probability of it.

    The best language (the first by name in a tie) under equal priors. Null, empty or letterless text,
    or a model without languages, gives ``und`` and 0. Only the text enters; repeated rows get the
    same result; columns of the new names are replaced.
    """
    docs = docs.drop(name_col, score_col)
    place = docs.columns.index("text")

    def predict(batches):
        letters = _letters(model.letters)
        names = np.array(model.languages + [UNDETERMINED], object)
        k = len(model.languages)
        for batch in batches:
            best = np.full(batch.num_rows, k)
            score = np.zeros(batch.num_rows)
            for first, run in _text_runs(batch.column(place)):
                words = _Words(run, letters)
                if not len(words.begin) or not k:
                    continue
                _, one, each = np.unique(
                    words.hash(words.begin, words.end), return_index=True, return_inverse=True
                )
                per_word = _word_scores(model, words, words.begin[one], words.end[one])
                total = np.stack(
                    [np.bincount(words.doc, per_word[each, c], len(run)) for c in range(k)], 1
                )
                share = np.exp(total - total.max(1, keepdims=True))
                some = np.bincount(words.doc, minlength=len(run)) > 0
                rows = slice(first, first + len(run))
                best[rows] = np.where(some, total.argmax(1), k)
                score[rows] = np.where(some, share.max(1) / share.sum(1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score)],
                [*batch.schema.names, name_col, score_col],
            )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField(name_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    )
    return map_batches(docs, releasing(predict), schema)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``; see ``add_language``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = add_language(rows, model, "lang_pred", "score")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def q_op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(docs, fit_languages(docs))
