"""Document fingerprints from improbable features.

A feature is a window of ``WINDOW`` bytes, and one begins at every byte that has as many bytes after it; a
shorter text is one window, filled up with zeros. A first pass over all texts counts how many
windows have which entropy; the rarer a window's entropy, the higher its rank, and a hash of the window
decides between equals. A window that ranks highest in ``RUN`` consecutive ones (fewer at both
ends of a text) at least ``POPULAR`` times in a row is selected. Windows of very low entropy, such as runs
of one symbol, rank behind all others. Features go, in text order, into a chain of Bloom filters
with ``PER_FILTER`` features each. Two fingerprints are compared filter by filter: the bits in common
beyond chance, as a share of what is possible beyond chance.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .packing import pack_texts, unpack
from .textbatch import BYTE_VALUES, map_batches, mix, powers

WINDOW = 24
RUN = 64
POPULAR = 16
PER_FILTER = 160
BITS = 2048
PROBES = 5
LEAST = 1.0  # windows of fewer bits of entropy rank last
_CLASSES = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_UNITS = 100  # entropy is summed in hundredths of a bit for each byte of a window
_TERMS = np.array([round(_UNITS * c * np.log2(c)) if c else 0 for c in range(WINDOW + 1)], np.uint16)
_BIN = 4  # sums are counted in bins of 2**_BIN
_BINS = (int(_TERMS[-1]) >> _BIN) + 1
_LOW = int(_UNITS * WINDOW * (np.log2(WINDOW) - LEAST)) >> _BIN  # first bin below LEAST
_PAD = max(RUN, WINDOW)  # no run of windows reaches from one text into another
_LAST, _NONE = np.uint64(0xFFFE), np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 1 << 18

Digest = tuple[np.ndarray, np.ndarray]  # features per filter, filters as rows of 64-bit words


class _Buffer:
    """Texts with padding around them, and which places begin a window."""

    def __init__(self, texts: list[bytes]):
        pad = b"\0" * _PAD
        self.bytes = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = _PAD + np.cumsum(sizes + _PAD) - sizes - _PAD
        self.ends = starts + sizes
        change = np.zeros(len(self.bytes) + 1, np.int8)
        some = sizes > 0
        change[starts[some]] = 1
        change[np.maximum(self.ends - WINDOW, starts)[some] + 1] = -1
        self.begins = np.cumsum(change[: len(self.bytes) - WINDOW + 1], dtype=np.int8) > 0

    def bins(self) -> np.ndarray:
        """Entropy bin of the window at every place, 0 for the highest entropy; a byte counts by
        its low five bits."""
        symbols = self.bytes & np.uint8(_CLASSES - 1)
        total = np.zeros(len(self.begins), np.uint16)
        seen = np.zeros(len(symbols) + 1, np.uint8)
        for c in np.flatnonzero(np.bincount(symbols, minlength=_CLASSES)):
            np.cumsum((symbols == c).view(np.uint8), dtype=np.uint8, out=seen[1:])  # wraps; differences stay right
            total += _TERMS.take(seen[WINDOW:] - seen[:-WINDOW])
        return total >> _BIN


def _runs(texts: list[bytes]):
    """Lists of consecutive texts of about ``_CHUNK`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text) + _PAD
        if size >= _CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """Number of windows by entropy bin."""
    counts = np.zeros(_BINS, np.int64)
    for run in _runs(texts):
        buf = _Buffer(run)
        counts += np.bincount(buf.bins()[buf.begins], minlength=_BINS)
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of every bin, 0 for the rarest; bins below ``LEAST`` come last."""
    ranks = np.empty(_BINS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(_BINS, dtype=np.uint64)
    ranks[_LOW:] = _LAST
    return ranks


def _select(buf: _Buffer, ranks: np.ndarray):
    """Selected features of the texts in a buffer, in order: owners and hashes."""
    n = len(buf.bytes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf.bytes] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[WINDOW:] - sums[:-WINDOW]) * powers(_INVERSE, n - WINDOW + 1))
    key = ranks[buf.bins()] << np.uint64(48) | hashes >> np.uint64(16)
    rarest = np.full(n + RUN, _NONE)
    rarest[RUN : RUN + len(key)][buf.begins] = key[buf.begins]
    width = 1
    while width < RUN:  # minimum over RUN windows, by doubling
        rarest = np.minimum(rarest[:-width], rarest[width:])
        width *= 2
    first = np.flatnonzero(np.append(True, rarest[1:] != rarest[:-1]))
    length = np.diff(np.append(first, len(rarest)))
    taken = first[(length >= POPULAR) & (rarest[first] != _NONE)]
    owners = np.searchsorted(buf.ends, taken - RUN, side="right")
    features = rarest[taken] & np.uint64((1 << 48) - 1)
    pairs = owners.astype(np.uint64) << np.uint64(48) | features
    _, once = np.unique(pairs, return_index=True)
    once.sort()
    return owners[once], features[once]


def _digest_run(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    owner, features = _select(_Buffer(texts), ranks)
    count = np.bincount(owner, minlength=len(texts))
    filters = -(-count // PER_FILTER)
    base = np.cumsum(filters) - filters
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    row = base[owner] + place // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    spread = mix(features)
    for k in range(PROBES):
        bits[row, (spread >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    held = np.bincount(row, minlength=len(packed))
    return [(held[f : f + n], packed[f : f + n]) for f, n in zip(base, filters)]


def digest(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """Fingerprints of ``texts``, with the ranks of the entropy bins."""
    return [d for run in _runs(texts) for d in _digest_run(run, ranks)]


def as_string(d: Digest) -> str:
    held, filters = d
    return base64.b64encode(held.astype("<u2").tobytes() + filters.tobytes()).decode()


def likeness(one: Digest, two: Digest) -> float:
    """Share of the smaller fingerprint found in the other beyond chance, 0 to 1.

    Each filter of the chain with fewer filters counts by its features, with its best partner. No
    features on either side: 1, on one side only: 0.
    """
    if not len(one[0]) or not len(two[0]):
        return float(len(one[0]) == len(two[0]))
    if (len(one[0]), one[0].sum()) > (len(two[0]), two[0].sum()):
        one, two = two, one
    ones, others = (np.bitwise_count(d[1]).sum(1, dtype=np.int64) for d in (one, two))
    total = 0.0
    for held, row, n in zip(one[0], one[1], ones):
        common = np.bitwise_count(row & two[1]).sum(1, dtype=np.int64)
        top = np.minimum(n, others)
        chance = n * others / BITS
        few, many = np.minimum(n, others), np.maximum(n, others) / BITS
        chance = np.minimum(chance + 2.5 * np.sqrt(few * many * (1 - many)), top - 1)
        total += held * np.clip((common - chance) / (top - chance), 0, 1).max()
    return float(total / one[0].sum())


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _results(ids: list, texts: list[str], following: list[str], ranks: np.ndarray, digests=None) -> list[pa.Array]:
    edited = [_edited(t, f).encode() for t, f in zip(texts, following)]
    raw = [t.encode() for t in texts]
    own = digests or digest(raw, ranks)
    after = own[1:] + digest([following[-1].encode()], ranks) if digests is None and texts else None
    if after is None or any(f != t for f, t in zip(following[:-1], texts[1:])):
        after = digest([f.encode() for f in following], ranks)
    changed = digest(edited, ranks)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array(map(as_string, own), pa.string()),
        pa.array(map(as_string, changed), pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
    ]


NAMES = [c.split()[0] for c in RESULT.split(", ")]


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy bins from all windows of all texts. Every task sends on one row per
    bin, and so many rows reach the driver."""

    def count(batches):
        counts = np.zeros(_BINS, np.int64)
        for batch in batches:
            counts += entropy_counts([t.encode() for t in batch.column(0).fill_null("").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS)), pa.array(counts)], ["bin", "n"])

    found = map_batches(docs.select("text"), count, "bin long, n long")
    counts = np.zeros(_BINS, np.int64)
    for bin_, n in found.groupBy("bin").agg(F.sum("n")).collect():
        counts[bin_] = n
    return rarity_ranks(counts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs`` (``doc_id, text``); columns as in ``RESULT``.

    The edited text has its last quarter of code points replaced by as many from the start of the next
    document by ``doc_id`` (null ids first, equal ids by a hash of the text; the first follows the
    last). Null text counts as empty, with an empty fingerprint. Other columns are ignored. Fingerprints
    can be compared within one call, since all texts of ``docs`` decide which entropies are rare.

    One range shuffle sorts the documents. A task does all rows but its last, whose next document
    is the first of a later task; those few are written with both ends and done in a second step.
    """
    ranks = corpus_ranks(docs)
    rows = pack_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("tie", F.xxhash64("blob"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = f"{RESULT}, part int, head binary, own binary, open_id long"

    def run(batches):
        part, held, begun = TaskContext.get().partitionId(), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            blobs = batch.column(1).to_pylist()
            if held:
                ids, blobs = [held[0], *ids], [held[1], *blobs]
            texts = [unpack(b).decode() for b in blobs]
            columns = _results(ids[:-1], texts[:-1], texts[1:], ranks)
            n = len(ids) - 1
            head = [None] * n
            if not begun and n:
                head[0], begun = blobs[0], True
            extra = [pa.array([part] * n, pa.int32()), pa.array(head, pa.binary())]
            extra += [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
            held = ids[-1], blobs[-1]
            if n:
                yield pa.RecordBatch.from_arrays(columns + extra, [*NAMES, "part", "head", "own", "open_id"])
        if held:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.nulls(1, t) for t in types]
            columns += [pa.array([part], pa.int32()), pa.array([None if begun else held[1]], pa.binary())]
            columns += [pa.array([held[1]], pa.binary()), pa.array([held[0]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "part", "head", "own", "open_id"])

    done = materialize(map_batches(ordered, run, schema), "fingerprints")
    heads = done.filter("head IS NOT NULL").select(F.col("part").alias("next"), "head")
    # one small row per task
    parts = heads.select(F.col("next").alias("part"))
    turn = Window.orderBy("part")
    first = F.min("part").over(Window.partitionBy())
    parts = parts.select("part", F.coalesce(F.lead("part").over(turn), first).alias("next"))
    ends = done.filter("own IS NOT NULL").select("part", "own", "open_id")
    ends = ends.join(parts, "part").join(heads, "next").select("open_id", "own", "head")

    def finish(batches):
        for batch in batches:
            texts, following = ([unpack(b).decode() for b in batch.column(i).to_pylist()] for i in (1, 2))
            own = digest([t.encode() for t in texts], ranks)
            yield pa.RecordBatch.from_arrays(
                _results(batch.column(0).to_pylist(), texts, following, ranks, own), NAMES
            )

    return done.filter("own IS NULL").select(*NAMES).unionByName(map_batches(ends, finish, RESULT))


def q_op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
