"""Ranked lexical search: Block-Max MaxScore over an inverted index in segments.

A task turns its documents into segments of about ``SEGMENT_TERMS`` terms. In a segment documents are numbered by
ascending id; the list of a term is cut into blocks of ``BLOCK`` postings, each a varint blob of gaps and
counts. Beside the blob lies, for every count in the block, the least document length: from them the exact
block maximum follows for any corpus statistics, so that one pass over the texts is enough.

A query takes a segment in windows of documents. Its lists are put in order of their bounds
(weight times largest block maximum); those whose bounds together cannot reach the k-th best score so far
are not essential. Only essential lists bring up candidates. A candidate is dropped when what it has and the block
maxima of the other lists cannot reach that score either; only for the rest are blocks of those lists
decompressed, list by list, while the bound is tested again. The best of each segment are merged.

Queries go in blocks of ``ITEMS`` against all segments; a task gets one block, one segment and only the lists
whose terms occur in the block. The only numbers that pass the driver are the count of documents, of terms and of items.

Defined results: a row of the items is an item of its own, a row of the documents a document of its own, whatever
their ids; null or empty texts have no terms and are neither found nor find anything; documents without an id come
after the others of their score; no tables, no rows. Other columns are not read.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_row_index
from ..session import shared_dir
from .textbatch import FOLDED, Chunk, map_batches, mix, powers, text_chunks

SEGMENT_TERMS = 1 << 21  # terms in a segment, if no document is longer
SEGMENT_DOCS = 1 << 16
BLOCK = 128  # postings in a block
WINDOW = 1 << 12  # documents that a query looks at together
ITEMS = 256  # items in a block of queries
BEST = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_TERM = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_TERM[_low:_high] = True
POSTINGS = (
    "kind string, segment long, term long, block int, last int, count long, terms long, "
    "counts array<int>, shortest array<int>, blob binary"
)


def find_terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of a chunk and the number of its row in the chunk; A-Z count as a-z."""
    buf, n = chunk.buf, len(chunk.buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_TERM[buf]
    cut = np.zeros(n + 1, bool)
    cut[chunk.starts] = cut[n] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(FOLDED[buf] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * powers(_INVERSE, n + 1)[begin])
    return hashes.view(np.int64), np.searchsorted(chunk.starts, begin, side="right") - 1


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits a byte, and where each value begins (one more at the end)."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >> bits > 0
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        more = (sizes[has] > i + 1).astype(np.uint8) << 7
        out[at[:-1][has] + i] = (values[has] >> (7 * i) & 127).astype(np.uint8) | more
    return out, at


def _unvarint(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(at.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _segment(ids: list[int | None], hashes: np.ndarray, rows: np.ndarray, segment: int, schema: pa.Schema):
    """Record batches of one segment: the lists of all its terms and a row with its documents."""
    n = len(ids)
    missing = np.array([i is None for i in ids], bool)
    keys = np.array([i or 0 for i in ids], np.int64)
    order = np.lexsort((keys, missing))
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    docs = number[rows]
    length = np.bincount(docs, minlength=n)
    blob = keys[order].tobytes() + length.astype(np.int64).tobytes() + missing[order].tobytes()
    about = ("documents", segment, None, 0, n, int((length > 0).sum()), len(rows), [], [], blob)
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, about))], schema)
    if not len(rows):
        return
    terms, code = np.unique(hashes, return_inverse=True)
    pairs, count = np.unique(code * n + docs, return_counts=True)
    code, docs = np.divmod(pairs, n)
    # blocks: every BLOCK postings of a term begin a new one
    first = np.flatnonzero(np.diff(code, prepend=-1))
    rank = np.arange(len(code)) - first[code]
    start = np.flatnonzero(rank % BLOCK == 0)
    stop = np.append(start[1:], len(code))
    block = np.repeat(np.arange(len(start)), stop - start)
    gaps = np.diff(docs, prepend=0)
    gaps[start] = docs[start]
    data, at = _varints(np.stack([gaps, count - 1], axis=1).ravel())
    # for every count in a block the least document length
    by_count = np.lexsort((count, block))
    new = np.flatnonzero(np.diff(block[by_count], prepend=-1) | np.diff(count[by_count], prepend=0))
    least = np.minimum.reduceat(length[docs][by_count], new)
    lists_at = np.append(np.searchsorted(block[by_count][new], np.arange(len(start))), len(new))
    columns = [
        pa.array(["postings"] * len(start)),
        pa.array(np.full(len(start), segment)),
        pa.array(terms[code[start]]),
        pa.array((rank[start] // BLOCK).astype(np.int32)),
        pa.array(docs[stop - 1].astype(np.int32)),
        pa.array(stop - start),
        pa.array(np.add.reduceat(count, start)),
        _lists(count[by_count][new], lists_at),
        _lists(least, lists_at),
        _binary(data, at[2 * np.append(start, len(code))]),
    ]
    table = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    for begin in range(0, len(table), 8192):
        yield table.slice(begin, 8192)


@dataclass
class Index:
    """``documents``: a row per segment; ``postings``: a row per block of a list."""

    documents: DataFrame
    postings: DataFrame


def build_index(docs: DataFrame, path: str | None = None, text_col: str = "text") -> Index:
    """Index every row below ``path`` (a new shared folder if not given); texts are read once and not shuffled."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    ints = pa.list_(pa.int32())
    schema = pa.schema(
        [("kind", pa.string()), ("segment", pa.int64()), ("term", pa.int64()), ("block", pa.int32())]
        + [("last", pa.int32()), ("count", pa.int64()), ("terms", pa.int64())]
        + [("counts", ints), ("shortest", ints), ("blob", pa.binary())]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, hashes, rows, held = 0, [], [], [], 0
        task = TaskContext.get().partitionId() << 32

        def flush():
            return _segment(ids, np.concatenate(hashes), np.concatenate(rows), task + made, schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for chunk in text_chunks(batch.column(1)):
                found, row = find_terms(chunk)
                hashes.append(found)
                rows.append(row + len(ids))
                ids += keys[chunk.first : chunk.first + len(chunk.starts)]
                held += len(found)
                if held >= SEGMENT_TERMS or len(ids) >= SEGMENT_DOCS:
                    yield from flush()
                    made, ids, hashes, rows, held = made + 1, [], [], [], 0
        if ids:
            yield from flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    map_batches(source, index, POSTINGS).write.partitionBy("kind").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    read = spark.read.schema(POSTINGS)
    return Index(*(read.parquet(path).filter(F.col("kind") == k).drop("kind") for k in ("documents", "postings")))


class _List:
    """A term's list in one segment; blocks are decompressed when they are first needed."""

    def __init__(self, last, top, sizes, blobs, saturation):
        self.last, self.top, self._blobs, self._saturation = last, top, blobs, saturation
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        # blocks not yet read are filled with their last document, so the array is always sorted
        self.docs = np.repeat(last, sizes)
        self.values = np.zeros(len(self.docs), np.int64)
        self._ready = np.zeros(len(last), bool)

    def read(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self._ready[blocks]]
        if not len(blocks):
            return
        self._ready[blocks] = True
        found = _unvarint(np.frombuffer(b"".join([self._blobs[b] for b in blocks]), np.uint8))
        gaps, counts = found[::2], found[1::2] + 1
        sizes = self.at[blocks + 1] - self.at[blocks]
        starts = np.cumsum(sizes) - sizes
        sums = np.cumsum(gaps)
        docs = sums - np.repeat(sums[starts] - gaps[starts], sizes)
        places = np.arange(len(docs)) + np.repeat(self.at[blocks] - starts, sizes)
        self.docs[places] = docs
        self.values[places] = self._saturation(counts, docs)

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to ``high`` (not included) and their values."""
        first, stop = np.searchsorted(self.last, [low, high])
        stop = min(stop + 1, len(self.last))
        if first >= stop:
            return self.docs[:0], self.values[:0]
        self.read(np.arange(first, stop))
        docs = self.docs[self.at[first] : self.at[stop]]
        a, b = np.searchsorted(docs, [low, high]) + self.at[first]
        return self.docs[a:b], self.values[a:b]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each document would be in (or one too many) and its maximum."""
        block = np.searchsorted(self.last, docs)
        return block, np.append(self.top, 0)[block]

    def exact(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        inside = block < len(self.last)
        self.read(np.unique(block[inside]))
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(inside & (self.docs[at] == docs), self.values[at], 0)


def max_score(lists: list[_List], weights: list[int], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of a segment and their scores; of equal ones the first."""
    bounds = np.array([w * int(x.top.max()) for x, w in zip(lists, weights)], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, weights = [lists[i] for i in order], [weights[i] for i in order]
    reach = np.cumsum(bounds[order])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, n_docs, WINDOW):
        essential = int(np.searchsorted(reach, least))  # all lists before it together stay below ``least``
        if essential == len(lists):
            break
        total = np.zeros(WINDOW, np.int64)
        for x, w in zip(lists[essential:], weights[essential:]):
            found, values = x.between(low, low + WINDOW)
            total[found - low] += w * values
        near = np.flatnonzero(total)
        score = total[near]
        near = near + low
        if essential:
            keep = score + reach[essential - 1] >= least
            near, score = near[keep], score[keep]
            tops = [(x.bounds(near), w) for x, w in zip(lists[:essential], weights)]
            upper = score + sum(w * top for (_, top), w in tops)
            keep = upper >= least
            for i in reversed(range(essential)):
                (block, top), w = tops[i]
                at = np.flatnonzero(keep)
                if not len(at):
                    break
                upper[at] += w * (lists[i].exact(near[at], block[at]) - top[at])
                keep[at] = upper[at] >= least
            near, score = near[keep], upper[keep]
        docs, scores = np.concatenate([docs, near]), np.concatenate([scores, score])
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
        if len(docs) == k:
            least = int(scores[-1]) + 1  # later documents have larger numbers and lose ties
    return docs, scores


def _searcher(k: int, n_docs: int, n_terms: int):
    """Runs the items of a block of queries over one segment."""

    def saturate(count, length):
        floor = 75 + 25 * length * n_docs // n_terms
        return 1_000_000_000 * count // (1000 * count + 12 * floor)

    def run(rows: pa.Table, head: pa.Table) -> pa.Table:
        out = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        if not len(rows) or not len(head):
            return out.empty_table()
        n, blob = head["last"][0].as_py(), head["blob"][0].as_py()
        keys, length = np.frombuffer(blob, np.int64, 2 * n).reshape(2, n)
        missing = np.frombuffer(blob, bool, n, 16 * n)
        rows = rows.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        flat = [rows[c].combine_chunks() for c in ("counts", "shortest")]
        tops = saturate(*(np.asarray(c.flatten()).astype(np.int64) for c in flat))
        sizes = np.asarray(flat[0].value_lengths())
        tops = np.maximum.reduceat(tops, np.cumsum(sizes) - sizes)
        terms, last = rows["term"].to_numpy(), rows["last"].to_numpy().astype(np.int64)
        postings, blobs = rows["count"].to_numpy(), rows["blob"].to_pylist()
        starts = np.flatnonzero(np.diff(terms, prepend=terms[0] - 1))
        lists = {}
        for a, b in zip(starts, np.append(starts[1:], len(terms))):
            lists[int(terms[a])] = _List(
                last[a:b], tops[a:b], postings[a:b], blobs[a:b], lambda c, d: saturate(c, length[d])
            )
        found = []
        for query in head["queries"][0].as_py():
            here = [t for t in query["terms"] if t["term"] in lists and t["weight"] > 0]
            if here:
                docs, scores = max_score(
                    [lists[t["term"]] for t in here], [t["weight"] for t in here], n, k
                )
                found.append((np.full(len(docs), query["item"]), docs, scores))
        if not found:
            return out.empty_table()
        items, docs, scores = (np.concatenate(c) for c in zip(*found))
        return pa.table([pa.array(items), pa.array(keys[docs], mask=missing[docs]), pa.array(scores)], schema=out)

    return run


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, term, times`` of the items' texts."""

    def split(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for chunk in text_chunks(batch.column(1)):
                found, row = find_terms(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[chunk.first + row]), pa.array(found)], ["item", "term"]
                )

    words = map_batches(items.select("item", "text"), split, "item long, term long")
    return words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def search(index: Index, items: DataFrame, k: int = BEST, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items``."""
    size = index.documents.agg(F.sum("count"), F.sum("terms"), F.count(F.lit(1))).first()
    n_docs, n_terms = size[0] or 0, size[1] or 0
    named = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    named = with_row_index(named, "item_id", "text").withColumnRenamed("row_index", "item")
    n_items = named.count()
    blocks = max(1, -(-n_items // ITEMS))
    asked = _item_terms(named)
    # weights need the document counts of asked terms only; blob columns are not read here
    spread = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    spread = spread.groupBy("term").agg(F.sum("count").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.floor(1000.0 * F.log(ratio)) * F.col("times")
    weighed = asked.join(spread, "term").select(
        "item", "term", weight.alias("weight"), F.floor(F.col("item") / ITEMS).alias("part")
    )
    queries = (
        weighed.groupBy("part", "item")
        .agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("item", "terms")).alias("queries"))
    )
    hits = index.postings.drop("terms").join(weighed.select("part", "term").distinct(), "term")
    parts = F.sequence(*[F.lit(b).cast("long") for b in (0, blocks - 1)])
    heads = index.documents.select("segment", "last", "blob", F.explode(parts).alias("part"))
    found = (
        hits.groupBy("segment", "part")
        .cogroup(heads.join(queries, "part").groupBy("segment", "part"))
        .applyInArrow(_searcher(k, n_docs, max(n_terms, 1)), "item long, doc_id long, score long")
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def q_op12_search(spark, sf_dir):
    """The 20 best documents for every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(build_index(docs), items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"""unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"""

ORACLES = {
    "op12_search": f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
postings AS MATERIALIZED (
  SELECT id, term, count(*) AS tf FROM (SELECT id, {_TERMS} AS term FROM rows) GROUP BY id, term),
lengths AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY id),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM postings, size GROUP BY term, docs),
asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark))
  GROUP BY ALL),
scores AS (
  SELECT item, any_value(item_id) AS item_id, id, CAST(sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (id), size
  GROUP BY item, id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT s.*, doc_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scores s JOIN rows USING (id) WHERE score > 0)
WHERE rank <= 20
"""
}
