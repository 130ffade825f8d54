import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from sitepulse.llm import catalog, langid, mixing, ngram_join, pieces, pii

SF_DIR = "/root/testdata/sf0.001"
STAGE = corpus_pipeline.COPY_WORDS, corpus_pipeline.COPY_PERCENT
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = {
        "language": lambda d: {
            r.doc_id
            for r in langid.predict_languages(d, langid.fit_languages(d)).collect()
            if r.lang_pred != "und" and r.score >= corpus_pipeline.SURE
        },
        "near copies": lambda d: {r.component_id for r in ngram_join.similar_groups(d, *STAGE).collect()},
        "personal data": lambda d: {r.doc_id for r in d.collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.mix_sources(d).collect() if r.copies},
        "pieces": lambda d: {r.doc_id for r in d.collect()},
    }
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        kept = stage(spark, docs, SF_DIR).cache()
        assert {r.doc_id for r in kept.select("doc_id").collect()} == expected[name](docs)
        if name != "pieces":
            assert kept.columns == COLUMNS
        if name == "language":
            assert kept.count() >= 0.97 * before
        docs = kept
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    for r in docs.collect():
        assert list(r.piece_ids) == library.encode(r.text) and r.round_trip
        assert r.n_pieces == len(r.piece_ids) and r.n_chars == len(r.text)
    assert docs.filter("text rlike '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count() <= 2
    assert not [r for r in pii.base_spans(docs).collect() if r.base]


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, "the cat " * 40, "en", None, 0), (1, "the cat " * 40, "en", None, 0), (None, "le chat", "fr", "a", 1)]
    rows += [(3, None, None, "b", None), (4, "", "en", "b", 0), (5, "+1 (988) 555-2485 the end", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF_DIR)
        assert table.count() >= 0


COPY = " ".join(f"word{i}" for i in range(80))
COPY_ROWS = [
    (3, COPY), (7, COPY + " more"), (7, "something else entirely under the same id"), (7, COPY + " more"),
    (None, COPY), (None, COPY), (9, COPY), (11, "a text of its own"), (11, "a text of its own"), (12, COPY + " again"),
    (11, COPY + " once more"), (20, None), (21, ""),
]


def test_near_copies_go_by_id_and_text(spark):
    """Only copies of a kept text go; rows without an id stay, and so does another text under a copy's id."""
    docs = spark.createDataFrame([(*r, "x") for r in COPY_ROWS], "doc_id long, text string, node string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), SF_DIR)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    expected = [(3, COPY), (7, "something else entirely under the same id"), (11, "a text of its own")]
    expected += [(None, COPY), (None, COPY), (20, None), (21, "")]
    assert found == sorted(expected, key=repr)


HELPERS = (
    "copies", "_id", "_fp", "_marks", "_copy", "_no", "_lang_pred", "_lang_score", "_row", "_new", "_null", "_decoded",
    "row", "node", "text_hash", "place", "fp", "unit", "taken", "size", "Node",
)


def test_columns_with_the_names_of_helpers_pass_all_stages(spark):
    spark.conf.set("spark.sql.caseSensitive", "false")
    rows = [(i, f"the cat sat on the mat near the number {i} house, mail me at me{i}@mail.org", "en", "ab"[i % 2], 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [h for h in HELPERS if h != "Node"]
    docs = docs.withColumns({h: F.concat(F.lit(f"{h}-"), F.col("doc_id")) for h in extra})
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF_DIR)
        assert table.columns[: len(docs.columns)] == docs.columns, name
    found = table.collect()
    assert found
    for r in found:
        assert all(r[h] == f"{h}-{r.doc_id}" for h in extra)


def test_registered():
    names = catalog.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(names)
