"""Self-join of documents on the Jaccard similarity of their word n-grams.

The global order of n-grams is their 64-bit hash, cut into ``FRAGMENTS`` equal ranges. Within the
first fragment n-grams are ordered by their number of documents, rare ones first. Two similar sets
share one of their first ``size - ceil(t * size) + 1`` n-grams in this order, so only those
are matched; passages that many documents share stay out of them. The overlap of a matched
pair is then counted fragment by fragment and summed.

Documents with equal sets form a class, of which the smallest ``doc_id`` takes part. Pairs are not
expanded to rows: the classes lie in blocks of ``BLOCK``, any two blocks that share an n-gram of their
prefixes are compared as a whole, and the number of such pairs of blocks grows with the square of
the blocks that an n-gram is in.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_row_index
from ..session import materialize
from .components import connected_components, least_reached
from .packing import pack_texts, unpack_column
from .textbatch import FOLDED, find_words, map_batches, releasing, text_chunks, window_hashes

GRAM_WORDS = 4
PERCENT = 85
FRAGMENTS = 4
BLOCK = 128
DENSE = 8  # n-grams in more sets of a block than this are counted by a matrix product
COLUMNS = 4096
_SHIFT = np.uint64(62)  # the two leading bits number the fragment


def _gram_sets(column: pa.Array, width: int):
    """For each row of a text column its number and its sorted distinct n-gram hashes."""
    for chunk in text_chunks(column):
        words = find_words(chunk, FOLDED)
        grams = window_hashes(words.hash, width)
        for d in range(len(chunk.starts)):
            a, b = words.first[d], words.first[d + 1]
            if b - a >= width:
                yield chunk.first + d, np.unique(grams[a : b - width + 1])
            elif b > a:
                yield chunk.first + d, window_hashes(words.hash[a:b], int(b - a))
            else:
                yield chunk.first + d, np.zeros(0, np.uint64)


def prefix_size(n, percent: int):
    """How many first n-grams of a set of ``n`` suffice to meet every similar set."""
    return n - (percent * n + 99) // 100 + 1


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def gram_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: set size, digest of the set, and the n-grams that may be needed for matching.

    Those are all of the first fragment (``n_lead`` of them) and, should they be fewer than
    the prefix, the next ones in order. An empty set and a null ``doc_id`` have no digest.
    """

    def build(batches):
        for batch in batches:
            ids, sizes, leads, digests, keys = batch.column(0), [], [], [], []
            for row, grams in _gram_sets(batch.column(1), width):
                lead = int(np.searchsorted(grams, np.uint64(1) << _SHIFT))
                usable = len(grams) and ids[row].is_valid
                digests.append(blake2b(grams.tobytes(), digest_size=16).digest() if usable else None)
                sizes.append(len(grams))
                leads.append(lead)
                most = max(lead, prefix_size(len(grams), percent)) if usable else 0
                keys.append(grams[:most])
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(sizes, pa.int64()),
                    pa.array(leads, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(keys),
                ],
                ["doc_id", "n_shingles", "n_lead", "digest", "keys"],
            )

    return map_batches(
        docs.select("doc_id", "text"),
        releasing(build),
        "doc_id long, n_shingles long, n_lead long, digest binary, keys array<long>",
    )


def _prefixes(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``key, doc, n``: the prefix of one document per class, without n-grams found once."""
    tokens = sets.select("doc_id", F.explode("keys").alias("key"))
    counts = materialize(tokens.groupBy("key").count().filter("count > 1"), "counts")
    common = tokens.join(counts, "key").groupBy("doc_id")
    common = common.agg(F.collect_set(F.struct("count", "key")).alias("found"))

    def choose(batches):
        for batch in batches:
            ids, sizes, leads, found = (c for c in batch.columns)
            out_key, out_doc, out_n = [], [], []
            for doc, n, lead, pairs in zip(ids.to_pylist(), sizes.to_pylist(), leads.to_pylist(), found):
                count = pairs.values.field("count").to_numpy()
                key = pairs.values.field("key").to_numpy()
                first = key.view(np.uint64) >> _SHIFT == 0
                order = np.lexsort((key[first], count[first]))
                alone = lead - len(order)
                taken = key[first][order[: max(0, prefix_size(n, percent) - alone)]]
                taken = np.append(taken, key[~first])
                out_key.append(taken)
                out_doc.append(np.full(len(taken), doc))
                out_n.append(np.full(len(taken), n))
            if out_key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (out_key, out_doc, out_n)],
                    ["key", "doc", "n"],
                )

    members = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "n_lead").join(common, "doc_id")
    chosen = map_batches(members, releasing(choose), "key long, doc long, n long")
    return materialize(chosen, "prefixes")


def _blocks(prefixes: DataFrame) -> DataFrame:
    """``doc, n, block``: documents that share an n-gram of their prefixes, in small blocks.

    ``hint``, the smallest document met through a common n-gram, keeps most of a group together;
    sorted by it and the set size, every ``BLOCK`` rows begin a new block. Where a document
    lands matters for the amount of work only.
    """
    pivots = prefixes.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    pivots = materialize(pivots.filter("low < high").select("key", "low"), "pivots")
    hints = prefixes.join(pivots, "key").groupBy("doc").agg(
        F.min("low").alias("hint"), F.min("n").alias("n")
    )
    placed = with_row_index(hints, "hint", "n", "doc")
    block = F.xxhash64("hint", F.expr(f"row_index div {BLOCK}"))
    return materialize(placed.select("doc", "n", block.alias("block")), "blocks")


def _block_pairs(prefixes: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b``: blocks that have an n-gram in common and sizes that allow a link."""
    spans = blocks.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    rows = prefixes.select("key", "doc").join(blocks.select("doc", "block"), "doc")
    rows = materialize(rows.select("key", "block").distinct(), "keyblocks")
    left = rows.withColumnRenamed("block", "a")
    right = rows.withColumnRenamed("block", "b")
    pairs = left.join(right, "key").filter("a <= b").select("a", "b").distinct()
    pairs = pairs.join(spans.toDF("a", "lo_a", "hi_a"), "a").join(spans.toDF("b", "lo_b", "hi_b"), "b")
    fits = f"lo_a * {percent} <= hi_b * 100 AND lo_b * {percent} <= hi_a * 100"
    return materialize(pairs.filter(fits).select("a", "b"), "blockpairs")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: counted by fragment of the order, then summed."""
    total = np.zeros((len(sets), len(sets)), np.int64)
    bounds = np.arange(FRAGMENTS + 1, dtype=np.uint64)
    cuts = [np.searchsorted(s >> _SHIFT, bounds) for s in sets]
    for f in range(FRAGMENTS):
        parts = [s[c[f] : c[f + 1]] for s, c in zip(sets, cuts)]
        grams = np.concatenate(parts)
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        run = np.cumsum(np.append(True, grams[1:] != grams[:-1])) - 1 if len(grams) else grams
        count = np.bincount(run.astype(np.int64)) if len(grams) else np.zeros(0, int)
        few = count[run] <= DENSE if len(grams) else np.zeros(0, bool)
        some_run, some_owner = run[few], owner[few]
        for k in range(1, DENSE):  # rare n-grams: pair each place with the k-th next
            same = np.flatnonzero(some_run[k:] == some_run[:-k]) if k < len(some_run) else []
            if not len(same):
                break
            flat = some_owner[same] * len(sets) + some_owner[same + k]
            hits = np.bincount(flat, minlength=total.size).reshape(total.shape)
            total += hits + hits.T
        many_owner = owner[~few]
        many_run = np.unique(run[~few], return_inverse=True)[1]
        for base in range(0, many_run.max() + 1 if len(many_run) else 0, COLUMNS):  # common ones
            at = (many_run >= base) & (many_run < base + COLUMNS)
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[many_owner[at], many_run[at] - base] = 1
            total += (has @ has.T).astype(np.int64)
    return total


def _linked(pairs: DataFrame, docs: DataFrame, blocks: DataFrame, weights: DataFrame, width: int, percent: int):
    """``doc, root, links``: within a pair of blocks, a document's links and the smallest
    document that it reaches. Pairs of documents are never rows."""
    both = pairs.select("a", "b", F.col("a").alias("block"))
    both = both.union(pairs.filter("a <> b").select("a", "b", F.col("b")))
    tags = both.join(blocks.select("doc", "block"), "block")
    tags = tags.groupBy("doc").agg(F.collect_list(F.struct("a", "b", "block")).alias("tags"))
    tags = tags.join(weights.toDF("doc", "weight"), "doc").withColumnRenamed("doc", "doc_id")

    def spread(batches):
        for batch in batches:
            ids, weight = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            tags = batch.column(2).to_pylist()
            out = [], [], [], [], [], []
            for row, grams in _gram_sets(unpack_column(batch.column(1)), width):
                for tag in tags[row]:
                    values = tag["a"], tag["b"], tag["block"], ids[row], weight[row], grams.tobytes()
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["a", "b", "block", "doc", "weight", "grams"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def compare(table: pa.Table) -> pa.Table:
        a, b, block, doc, weight = (table.column(i).to_numpy() for i in range(5))
        sets = [np.frombuffer(g, np.uint64) for g in table.column(5).to_pylist()]
        size = np.array([len(s) for s in sets])
        common = _overlaps(sets)
        like = common * 100 >= (size[:, None] + size - common) * percent
        np.fill_diagonal(like, False)
        if a[0] != b[0]:
            like &= block[:, None] != block
        root = least_reached(like, doc)
        links = like @ weight
        some = links > 0
        return pa.table({"doc": doc[some], "root": root[some], "links": links[some]})

    rows = pack_texts(docs).join(tags.hint("shuffle_hash"), "doc_id")
    rows = map_batches(
        rows.select("doc_id", "blob", "tags", "weight"),
        releasing(spread),
        "a long, b long, block long, doc long, weight long, grams binary",
    )
    return rows.groupBy("a", "b").applyInArrow(compare, "doc long, root long, links long")


def similar_groups(docs: DataFrame, width: int = GRAM_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs`` (``doc_id, text``).

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``width``-word
    n-grams (A-Z in lower case; fewer words count as one n-gram). ``component_id`` is the smallest
    ``doc_id`` that can be reached, ``n_links`` the number of other rows linked directly. Null and empty texts have an empty set and link with nothing; a row
    with a null ``doc_id`` links with nothing and has a null component; rows that repeat a
    ``doc_id`` must carry the same text. Other columns are ignored. N-grams are compared by
    64-bit hashes, equal sets by 128-bit digests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(gram_sets(docs, width, percent), "sets")
    classes = materialize(
        sets.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("n_lead").alias("n_lead"),
            F.count(F.lit(1)).alias("members"),
        ),
        "classes",
    )
    prefixes = _prefixes(sets, classes, percent)

    blocks = _blocks(prefixes)
    pairs = _block_pairs(prefixes, blocks, percent)
    weights = classes.select("rep", "members")
    linked = materialize(_linked(pairs, docs, blocks, weights, width, percent), "linked")
    links = linked.groupBy("doc").agg(F.sum("links").alias("links"))
    found = connected_components(linked.select(F.col("doc").alias("u"), F.col("root").alias("v")))
    groups = links.join(found.toDF("doc", "component"), "doc")
    classes = classes.join(groups.withColumnRenamed("doc", "rep"), "rep", "left").select(
        "digest",
        F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"),
    )
    return sets.join(materialize(classes, "groups"), "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def q_op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES = {
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM d),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c >= 85 * (s.n + t.n - c)
),
reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT id, min(other) AS low FROM reach GROUP BY id),
counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  coalesce(counted.n, 0) AS n_links
FROM d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
LEFT JOIN counted ON counted.id = d.doc_id
"""
}
