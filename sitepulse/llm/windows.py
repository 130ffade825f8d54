"""Packing of tokenised documents into windows: bounded-space online packing.

Each task keeps ``OPEN`` windows. A document goes whole into the open window that it fits best (the
least room left). When it fits in none, its first ids fill up the fullest window, which is emitted
without padding and replaced by an empty one, and the rest is placed the same way. What is still open when
a task ends is merged: the leftovers of ``MERGED`` tasks are packed again in the same manner, and so on
until one task holds the last ``OPEN`` windows. Their rest is cut into windows whose sizes are powers of two, which
need no padding. So memory is bounded by the open windows, the merged share is ``OPEN`` windows
a task whatever its input, and nothing is padded.

Ids are those of the ``tokenizers`` library, found once per distinct word of a task: the
tokenizer drops white space and lets no token reach over it, so a text's ids are the ids
of its words (cut at ASCII white space) in order. The table of words is begun anew when it is full.

Defined results: null and empty texts are a document of the end mark alone; repeated rows and rows
without an id are documents like any other; an empty table gives no pieces; only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import codecs
import re
import string
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .textbatch import map_batches, text_chunks

WINDOW = 4096  # ids in a full sequence
OPEN = 16  # windows that a task keeps open
MERGED = 32  # tasks whose leftovers meet in one task
END = 2  # id after every document
WORDS_BYTES = 16 << 20  # characters of words whose ids a task remembers
TEXT_BYTES = 1 << 22  # bytes of texts that are encoded together, if none is longer
# Small letters of Latin-1, which the tokenizer's normal form leaves as they are; all of Latin-1, whose capital letters
# have one small letter each; letters and digits of which signs behind them are always separated (not U+0130: its small
# letter ends with a combining mark, which goes with the signs).
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
LATIN_1 = r"^[\x00-\x{FF}]*$"
LETTER_AT_END = (
    r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
    r"\x{391}-\x{3A1}\x{3A3}-\x{3C9}\x{410}-\x{44F}]$"
)
# The characters that byte-level models write for bytes.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _OWN]
BYTE_CHARS = "".join(chr(b if b in _OWN else 256 + _OTHERS.index(b)) for b in range(256))
BATCH_IDS = 1 << 20  # ids in a batch of pieces
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("round", pa.int32()),
        ("task", pa.int64()),
        ("number", pa.int64()),
        ("offset", pa.int64()),
        ("closed", pa.bool_()),
    ]
)
SCHEMA = (
    "doc_id long, start long, doc_tokens long, ids binary, "
    "round int, task long, number long, offset long, closed boolean"
)


class _Growing:
    """An array that doubles when it is full."""

    def __init__(self, dtype, *shape: int):
        self.data, self.used = np.zeros((1 << 16, *shape), dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros((2 * need - self.used, *self.data.shape[1:]), self.data.dtype)])
        self.data[self.used : need] = values
        self.used = need


@lru_cache(maxsize=1)
def _loaded(path: str):
    """The tokenizer, read once per Python worker and not for every task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class UnitIds(dict):
    """Ids of whole texts from remembered ids of units: the number of each unit.

    A word is a unit and a tail of ASCII signs behind a letter or digit, which the tokenizer always separates; a unit
    of Latin-1 characters stands for all its spellings in small and capital letters.
    """

    def __init__(self, path: str):
        self._tokenizer = _loaded(path)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self._bytes, self._ids, self._ends = 0, _Growing(np.uint32), _Growing(np.int64)
        self._ends.extend([0])

    def _learn(self, units: list[str]) -> None:
        """Number and encode units that are not known yet."""
        # words of small letters reach the tokenizer's model as they are, as characters for their bytes; of
        # anything else the tokenizer makes something first
        plain = [u for u in units if PLAIN.fullmatch(u)]
        others = [u for u in units if not PLAIN.fullmatch(u)]
        self.update(zip(chain(plain, others), range(len(self), len(self) + len(units))))
        self._bytes += sum(map(len, units))
        merge, ids, ends = self._tokenizer.model.tokenize, [], []
        for unit in plain:
            if not unit.isascii():
                unit = codecs.charmap_decode(unit.encode(), "strict", BYTE_CHARS)[0]
            ids += [token.id for token in merge(unit)]
            ends.append(len(ids))
        for encoded in self._tokenizer.encode_batch_fast(others, add_special_tokens=False):
            ids += encoded.ids
            ends.append(len(ids))
        self._ends.extend(np.array(ends) + self._ids.used)
        self._ids.extend(np.array(ids, np.uint32))

    @staticmethod
    def _units(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Core and tail of distinct words."""
        core = pc.ascii_rtrim(words, characters=string.punctuation)
        # "<|" may begin a special token, in which case and signs matter
        free = pc.invert(pc.match_substring(words, "<|"))
        marked = pc.and_(pc.and_(pc.not_equal(core, words), free), pc.match_substring_regex(core, LETTER_AT_END))
        signs = pc.replace_substring_regex(words.filter(marked), f"(?s)^.*[^{re.escape(string.punctuation)}]", "")
        tail = pc.replace_with_mask(pa.array([""] * len(words), words.type), marked, signs)
        core = pc.if_else(marked, core, words)
        any_case = pc.and_(pc.match_substring_regex(core, LATIN_1), free)
        return pc.if_else(any_case, pc.utf8_lower(core), core), tail

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text, each followed by ``END``."""
        if self._bytes > WORDS_BYTES:
            self._forget()
        words = pc.ascii_split_whitespace(texts)
        last = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        units = pa.concat_arrays(self._units(coded.dictionary)).dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(numbers < 0)
        if len(at):
            fresh = [names[i] for i in at.tolist()]
            self._learn(fresh)
            numbers[at] = [self[u] for u in fresh]
        parts = numbers[np.asarray(units.indices)].reshape(2, -1).T
        parts = parts[np.asarray(coded.indices)].ravel()
        first = self._ends.data[parts]
        sizes = self._ends.data[parts + 1] - first
        sums = np.cumsum(sizes)
        total = sums[-1] if len(sums) else 0
        flat = self._ids.data[np.repeat(first - sums + sizes, sizes) + np.arange(total)]
        begin = 0
        for end in np.append(0, sums)[2 * last]:
            yield np.append(flat[begin:end], np.uint32(END))
            begin = end


class Packer:
    """Bounded-space best fit. ``out`` collects the pieces of emitted windows as rows of ``PIECES``."""

    def __init__(self, round_: int, task: int):
        self._at = round_, task
        self._open: list[list[tuple]] = [[] for _ in range(OPEN)]
        self._room = np.full(OPEN, WINDOW)
        self._emitted = 0
        self.out: list[tuple] = []
        self.ids = 0

    def add(self, doc_id: int | None, start: int, total: int, ids: np.ndarray) -> None:
        """Place ``ids``, which begin ``start`` ids after the begin of a document of ``total`` ids."""
        while len(ids):
            fits = self._room >= len(ids)
            if fits.any():
                place = int(np.where(fits, self._room, WINDOW + 1).argmin())
            else:
                place = int(self._room.argmin())
            part, ids = ids[: self._room[place]], ids[self._room[place] :]
            self._open[place].append((doc_id, start, total, part.tobytes()))
            start += len(part)
            self._room[place] -= len(part)
            if not self._room[place]:
                self._emit(self._open[place], True)
                self._open[place], self._room[place] = [], WINDOW

    def _emit(self, pieces: list[tuple], closed: bool) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((*piece, *self._at, self._emitted, offset, closed))
            offset += len(piece[3]) // 4
        self._emitted += 1
        self.ids += offset

    def leave(self) -> None:
        """Hand out the open windows as leftovers."""
        for pieces in self._open:
            if pieces:
                self._emit(pieces, False)

    def finish(self) -> None:
        """Fill windows from the open ones; the last ids go into windows of powers of two."""
        left = sum(WINDOW - int(room) for room in self._room)
        sizes = [WINDOW] * (left // WINDOW) + [1 << b for b in reversed(range(12)) if left % WINDOW >> b & 1]
        pieces, window, room = [p for w in self._open for p in w], [], sizes.pop(0) if sizes else 0
        for doc_id, start, total, blob in pieces:
            while blob:
                part, blob = blob[: 4 * room], blob[4 * room :]
                window.append((doc_id, start, total, part))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    self._emit(window, True)
                    window, room = [], sizes.pop(0) if sizes else 0

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The collected pieces, once they hold more than ``least`` ids."""
        if self.out and self.ids > least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.out), PIECES)]
            yield pa.RecordBatch.from_arrays(columns, schema=PIECES)
            self.out, self.ids = [], 0


def _repack(round_: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("task", "ascending"), ("number", "ascending"), ("offset", "ascending")])
        packer = Packer(round_, rows["group"][0].as_py())
        for piece in rows.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            doc_id, start, total, blob = piece.values()
            packer.add(doc_id, start, total, np.frombuffer(blob, np.uint32))
        packer.finish() if last else packer.leave()
        return pa.Table.from_batches(packer.batches(), PIECES)

    return run


def pack_windows(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, doc_tokens``, ``ids`` (little-endian 32-bit),
    ``sequence_id`` and ``offset`` in that sequence.

    Texts are read once and never move; only the leftovers of a task are shuffled. Each
    round is written to the shared folder, so a lost executor costs its tasks, not other rounds.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"

    def pack(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, packer = UnitIds(tokenizer), Packer(0, TaskContext.get().partitionId())
        for batch in batches:
            keys = batch.column(0).to_pylist()
            column = batch.column(1).fill_null("").cast(pa.large_string())
            for chunk in text_chunks(column, TEXT_BYTES):
                texts = column.slice(chunk.first, len(chunk.starts))
                for doc_id, ids in zip(keys[chunk.first :], encoder.encode(texts)):
                    packer.add(doc_id, 0, len(ids), ids)
                    yield from packer.batches(BATCH_IDS)
        packer.leave()
        yield from packer.batches()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    map_batches(source, pack, SCHEMA).write.parquet(f"{folder}/0")
    rounds = [spark.read.schema(SCHEMA).parquet(f"{folder}/0")]
    done = False
    while not done:
        left = rounds[-1].filter("NOT closed")
        highest = left.agg(F.max("task")).first()[0]
        done = highest is None or highest < MERGED
        if highest is None:
            break
        grouped = left.withColumn("group", F.floor(F.col("task") / MERGED)).groupBy("group")
        path = f"{folder}/{len(rounds)}"
        grouped.applyInArrow(_repack(len(rounds), done), SCHEMA).write.parquet(path)
        rounds.append(spark.read.schema(SCHEMA).parquet(path))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    # 8 bits for the round, 24 for the task, 31 for the window of the task
    sequence = F.shiftleft(F.col("round").cast("long"), 55) + F.shiftleft("task", 31) + F.col("number")
    return out.filter("closed").select(
        "doc_id", "start", "doc_tokens", "ids", sequence.alias("sequence_id"), "offset"
    )


def q_op13_windows(spark, sf_dir):
    """All documents as pieces of sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_windows(docs).select(
        "doc_id",
        "start",
        F.floor(F.octet_length("ids") / 4).alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
