"""Manifest, lexical search and window packing against brute force, on tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitepulse.llm import lexical, manifest, windows

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# names that the operators use inside
EXTRA = ("grp", "key", "digest", "item", "part", "term", "task", "closed", "row_index", "ids")


def with_extra(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    words = sorted(words, key=lambda w: rnd.random())
    pick = lambda: words[min(int(rnd.expovariate(0.05)), len(words) - 1)]
    out = []
    for i in range(700):
        text = rnd.choice((" ", ", ", "\n")).join(pick() for _ in range(rnd.randint(1, 60)))
        lang = "en" if i % 3 else rnd.choice(("fr", "dé", None))
        out.append((i * 7 % 1000, text.title() if i % 5 == 0 else text, lang, rnd.choice(("s", None)), len(text)))
    out += [out[5], out[5], out[9]]  # repeated rows
    out += [(None, "a ab abc", "en", "s", 1), (None, "a ab abc", "en", "s", 1), (2001, None, "en", "s", None)]
    out += [(2002, "", "en", "s", 0), (2003, "A b" * 30_000, "xx", None, 9), (2004, "d" * 90_000, None, "s", 9)]
    out += [(out[3][0], "another text under an id that is there", "fr", "s", 2), (2005, " .,;  <|endoftext|>x", "en", "s", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return with_extra(table).repartition(5).cache()


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def steps(levels, place):
    for level in levels[:-1]:
        first = place // 8 * 8
        yield "".join(level[first:place]), "".join(level[place + 1 : first + 8])
        place //= 8


def test_manifest(spark, rows, folder):
    first = lambda value: (value is not None, value or 0)
    groups = {}
    for i, text, lang, source, n in rows:
        kept = "".join(map(field, (i, source, lang, n)))
        changed = text.translate(UPPER) if text and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else text
        groups.setdefault(lang, []).append((first(i), sha(kept + field(text)), i, sha(kept + field(changed))))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([leaf for _, leaf, _, _ in sorted(groups[lang], key=lambda r: r[:2])]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    expected = []
    for number, lang in enumerate(langs):
        for place, (_, leaf, i, presented) in enumerate(sorted(groups[lang], key=lambda r: r[:2])):
            path = [*steps(trees[lang], place), *steps(top, number)]
            for before, after in path:
                presented = sha(before + presented + after)
            proof = sha("".join(before + after for before, after in path))
            root = top[-1][0]
            expected.append((i, leaf, trees[lang][-1][0], root, proof, presented, presented == root))
    found = [tuple(r) for r in manifest.q_op11_manifest(spark, folder).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {r[-1] for r in found} == {True, False}


def leaves_of(docs):
    digest = manifest.leaf_digest(*[F.col(c) for c in manifest.DOCUMENT_FIELDS])
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), digest.alias("digest"))


def test_manifest_sizes(spark, tmp_path):
    """Groups of every shape, written and read again; all proofs lead to the same root."""
    sizes = [1, 7, 8, 9, 64, 65, 512, 513]
    table = spark.range(513).select("id", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter("id < size")
    table = table.select(F.format_string("%03d", "size").alias("grp"), F.col("id").alias("key"))
    digest = F.sha2(F.col("key").cast("string"), 256).alias("digest")
    built = manifest.build_manifest(table.select("*", digest), str(tmp_path / "m"))
    again = manifest.open_manifest(spark, built.path)
    found = manifest.proofs(again).withColumn("folded", manifest.fold(F.col("digest"), F.col("path"))).collect()
    assert len(found) == sum(sizes)
    trees = {f"{n:03d}": tree([sha(str(i)) for i in range(n)]) for n in sizes}
    top = tree([trees[g][-1][0] for g in sorted(trees)])
    assert {(r.grp, r.subroot) for r in found} == {(g, levels[-1][0]) for g, levels in trees.items()}
    assert {(r.root, r.folded) for r in found} == {(top[-1][0],) * 2}
    assert {(r.grp, len(r.path)) for r in found} == {(g, len(x) - 1 + len(top) - 1) for g, x in trees.items()}
    # between the leaves and the top only every third level is stored
    assert [d.count() for d in built.leaves] == [sum(sizes), 6 + 2, 1]


def test_manifest_empty(spark, docs):
    built = manifest.build_manifest(leaves_of(docs.limit(0)))
    assert manifest.proofs(built).count() == 0 and manifest.group_roots(built).count() == 0


def brute_search(rows, items, k):
    texts = [TERM.findall((text or "").translate(UPPER)) for _, text, *_ in rows]
    counts = [Counter(t) for t in texts]
    n_docs, total = sum(map(bool, texts)), sum(map(len, texts))
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, *_), terms, count in zip(rows, texts, counts):
            m = 75 + 25 * len(terms) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * count[t] // (1000 * count[t] + 12 * m))
                for t in TERM.findall((text or "").translate(UPPER))
                if t in count
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(best, 1)]
    return out


@pytest.fixture(scope="module")
def items(rows):
    rnd = random.Random(3)
    texts = [" ".join((rows[rnd.randrange(600)][1] or "").split()[:20]) for _ in range(40)]
    texts += ["nosuchterm", "", None, "a a a AB ab", "d" * 90_000, rows[7][1]]
    return [(i // 2, t) for i, t in enumerate(texts)] + [(None, "abc"), (1, "abc"), (1, "abc")]


@pytest.mark.parametrize("small", [True, False])
def test_search(spark, docs, rows, items, small, monkeypatch):
    """All rows are indexed and the result is exact, so recall is 1, whatever the sizes of blocks."""
    if small:
        for name, value in (("SEGMENT_DOCS", 150), ("BLOCK", 4), ("WINDOW", 32), ("ITEMS", 16)):
            monkeypatch.setattr(lexical, name, value)
    index = lexical.build_index(docs)
    assert index.documents.agg(F.sum("last")).first()[0] == len(rows)
    table = with_extra(spark.createDataFrame(items, "item_id long, text string"))
    for k in (20, 3):
        found = [tuple(r) for r in lexical.search(index, table, k).collect()]
        assert sorted(found, key=repr) == sorted(brute_search(rows, items, k), key=repr)


def test_search_leaves_blocks_unread(monkeypatch):
    """Blocks that cannot matter stay compressed."""
    monkeypatch.setattr(lexical, "WINDOW", 64)
    reads = []
    rare = np.array([5, 500]), np.array([900, 800])
    common = np.arange(1000), np.where(np.arange(1000) % 100 == 5, 90, 10)
    lists = []
    for docs, values in (rare, common):
        at = list(range(0, len(docs), 10))
        blobs = []
        for a in at:
            part = docs[a : a + 10]
            gaps = np.diff(part, prepend=0)
            blobs.append(lexical._varints(np.stack([gaps, 0 * gaps], 1).ravel())[0].tobytes())
        last = np.array([docs[a : a + 10][-1] for a in at])
        tops = np.maximum.reduceat(values, at)
        sizes = np.diff([*at, len(docs)])

        def value(count, found, docs=docs, values=values):
            reads.append(len(found))
            return values[np.searchsorted(docs, found)]

        lists.append(lexical._List(last, tops, sizes, blobs, value))
    docs, scores = lexical.max_score(lists, [1, 1], 1000, 2)
    assert list(docs) == [5, 500] and list(scores) == [990, 810]
    assert sum(reads) < 200  # of 1002 postings


def test_search_empty(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0


@pytest.mark.parametrize("merged", [2, 32])
def test_windows(spark, docs, rows, merged, monkeypatch):
    monkeypatch.setattr(windows, "MERGED", merged)
    monkeypatch.setattr(windows, "WORDS_BYTES", 200)  # the table of words is forgotten all the time
    library = Tokenizer.from_file(windows.TOKENIZER)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id, ids.tobytes()] += 1
    pieces = windows.pack_windows(docs).toPandas()
    assert not pieces.duplicated(["sequence_id", "offset"]).any()
    padding = 0
    for _, one in pieces.sort_values("offset").groupby("sequence_id"):
        sizes = one["ids"].map(len).to_numpy() // 4
        assert list(one["offset"]) == list(np.cumsum(sizes) - sizes) and (sizes > 0).all()
        used = int(sizes.sum())
        assert used <= windows.WINDOW
        padding += windows.WINDOW - used if used & (used - 1) else 0
    assert padding == 0
    # pieces of a document, put together, are its ids; equal rows may swap pieces
    sizes = pieces["ids"].map(len)
    assert sizes.sum() == sum(len(ids) * n for (_, ids), n in want.items())
    texts = {}
    for (doc_id, ids), n in want.items():
        texts.setdefault(None if doc_id is None else doc_id, []).append((ids, n))
    covered = Counter()
    for r in pieces.itertuples():
        doc_id = None if r.doc_id != r.doc_id else int(r.doc_id)
        options = [ids for ids, _ in texts[doc_id] if len(ids) == 4 * r.doc_tokens]
        assert any(ids[4 * r.start : 4 * r.start + len(r.ids)] == r.ids for ids in options)
        covered[doc_id] += len(r.ids)
    assert covered == {d: sum(len(ids) * n for ids, n in t) for d, t in texts.items()}


def test_windows_keep_short_documents_whole(spark):
    table = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat "), 60).alias("text"))
    pieces = windows.pack_windows(table.repartition(1))
    assert pieces.groupBy("doc_id").count().filter("count > 1").count() <= 400 * 121 // windows.WINDOW + 12


def test_windows_empty(spark, docs):
    assert windows.pack_windows(docs.limit(0)).count() == 0
    assert windows.pack_windows(docs.filter("doc_id = 2001")).select(F.hex("ids")).first()[0] == "02000000"


def encoded(texts):
    encoder = windows.UnitIds(windows.TOKENIZER)
    found = [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.large_string()))]
    library = Tokenizer.from_file(windows.TOKENIZER).encode_batch(texts, add_special_tokens=False)
    assert found == [[*text.ids, windows.END] for text in library]
    return encoder


def test_spellings_and_signs_share_a_unit():
    """Each is encoded once, whatever signs follow it and in whatever letters of Latin-1 it is written."""
    assert set(encoded(["r\u00e9r\u00e9, R\u00c9R\u00c9! r\u00e9r\u00e9$$$ R\u00e9r\u00e9,### the&&& THE"])) == {
        "r\u00e9r\u00e9", "the", "", ",", "!", "$$$", ",###", "&&&",
    }


def test_ids_of_odd_words_are_those_of_the_library():
    parts = [*"aesABZ0\u00c9\u00e9\u00df\u00fc\u00ff\u00d7\u00f7\u00b5\u00aa\u0130\u0131\u017f\u212a\u03a3\u03c3\u0416\u0439\u0301\u0338\u0307\u02bc\u2019\u4e2d"]
    parts += [*" .,;:!?$#&'()*-<=>|~\u00a0\u0085\u00ad", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'LL", "\U0001f600"]
    rnd = random.Random(9)
    encoded(["".join(rnd.choices(parts, k=rnd.randint(0, 20))) for _ in range(5000)])
