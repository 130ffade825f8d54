"""From raw documents to encoded training text, in stages that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitepulse.llm import langid, mixing, ngram_join, pieces, pii
from sitepulse.operators.ranks import with_row_index
from sitepulse.session import materialize, shared_dir

SURE = 0.5  # least posterior probability of a language
COPY_WORDS, COPY_PERCENT = 4, 85  # words of a shingle, least similarity of near copies: those of op6


def _free(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until no column of ``docs`` has them in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts of no clear language go."""
    lang, score = _free(docs, "_lang_pred", "_lang_score")
    found = langid.add_language(docs, langid.fit_languages(docs), lang, score)
    known = (F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= SURE)
    return found.filter(known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are similar in ``COPY_PERCENT`` of their shingles one stays, the one with the
    smallest id. A document is an id with a text: rows with both equal are one, different texts under
    one id are judged on their own. Rows without an id stay."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    # documents whose id stands for an earlier text too get a number of their own above all ids
    known = texts.filter("doc_id IS NOT NULL").select("doc_id", "fp").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("fp"))
    variants = materialize(known.withColumn("place", place).filter("place > 1").drop("place"), "variants")
    highest = texts.agg(F.max("doc_id")).first()[0] or 0
    numbered = with_row_index(variants, "doc_id", "fp").select(
        "doc_id", "fp", (F.col("row_index") + highest + 1).alias("number")
    )
    units = texts.join(numbered, ["doc_id", "fp"], "left").select(
        F.coalesce("number", "doc_id").alias("doc_id"), "text"
    )
    groups = ngram_join.similar_groups(units, COPY_WORDS, COPY_PERCENT)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("unit")).distinct()

    # The row travels as one column, so that its names cannot clash with those used here. Its key is its id and the
    # hash of its text; rows without an id have a number of their own and no hash, so each is alone.
    rows = docs.select(
        F.coalesce("doc_id", F.monotonically_increasing_id()).alias("doc_id"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).alias("fp"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    first = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy(F.xxhash64("row")))
    once = rows.withColumn("place", first).filter("place = 1")
    judged = once.join(numbered, ["doc_id", "fp"], "left").select(
        "row", F.when(F.col("fp").isNotNull(), F.coalesce("number", "doc_id")).alias("unit")
    )
    return judged.join(gone, "unit", "left_anti").select("row.*")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; no document goes."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays as often as the mix takes it: never, once or twice."""
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, their number, and whether they decode to the text (null counts as empty)."""
    model = pieces.load_pieces()
    decoded = _free(docs, "_decoded")[0]
    both = pieces.decode(pieces.encode(docs, model), model, decoded)
    return both.select(
        *[c for c in docs.columns if c not in ("piece_ids", "n_pieces", "round_trip")],
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_texts),
]

# No stage from the language model on can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
