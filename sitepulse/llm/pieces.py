"""SentencePiece encoding and decoding in numpy, many words at a time.

A text is cut between any two characters that stand side by side in no piece, which no encoding can
bridge. The distinct words of a batch advance together, character by character: all substrings that
end at the current character probe the sorted hashes of the pieces, every hit scores, and the
best one is stored as the back pointer.

With a unigram model the score is the sum of the piece scores. A byte-pair model has no such sum: its
encoding is the one the merges lead to. There a hit counts only if it may follow the piece that the
prefix before it ends with, that is, if merging the two strings gives back the two pieces; every
prefix then has exactly one way through, and the result is that of the merges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import map_batches, mix, powers

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = -2  # a character without a piece; bytes stand for it
CACHED_WORDS = 1 << 19
WORDS_AT_ONCE = 1 << 13
CELLS_AT_ONCE = 1 << 21  # longest word times words
CHUNK_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PROBE_BITS = 21
_NEVER = np.int64(1) << 40


def _code_hashes(codes: np.ndarray):
    values = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(codes)), out=sums[1:])
    back = powers(_INVERSE, len(codes) + 1)
    return lambda begin, end: mix((sums[end] - sums[begin]) * back[begin])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pair_slots(codes: np.ndarray) -> np.ndarray:
    both = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:].astype(np.uint64)
    return (mix(both) >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)


@dataclass
class PieceModel:
    """Tables of a model; their size depends on the vocabulary only."""

    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # and their ids
    probe: np.ndarray  # bit map of the leading bits of the hashes
    beside: np.ndarray  # bit map of character pairs inside pieces
    longest: int
    scores: np.ndarray
    merges: bool  # byte-pair model
    pair_keys: np.ndarray  # two pieces whose strings make a piece
    pair_rank: np.ndarray
    right: np.ndarray  # per piece, from its last character up to itself: ids
    left: np.ndarray  # the same from its first character
    rank: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece, or the unknown piece
    spelled: list[bytes]  # what each id decodes to
    prefix: bool  # a space is put in front of each text


def _bits(slots: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _PROBE_BITS, bool)
    table[slots] = True
    return np.packbits(table)


def _last_merges(pieces: dict[str, int], rank: np.ndarray) -> dict[int, tuple[int, int]]:
    """Per piece of several characters the two pieces that the merges make it from."""
    made = {}
    for text, number in pieces.items():
        parts = list(text)
        pair = None
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                whole = pieces.get(parts[i] + parts[i + 1])
                if whole is not None and (best is None or rank[whole] < best[0]):
                    best = rank[whole], i
            if best is None:
                pair = None
                break
            i = best[1]
            pair = pieces.get(parts[i]), pieces.get(parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if pair and None not in pair:
            made[number] = pair
    return made


def load_pieces(path: str = MODEL_FILE) -> PieceModel:
    """Read a model file on the driver. Its normalisation has to be the identity."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.decode(model.encode("ﬁ  x ")) != "ﬁ  x ":
        raise ValueError("only models without normalisation are supported")
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
    is_byte = [model.is_byte(i) for i in range(size)]
    texts = [model.id_to_piece(i) for i in range(size)]
    pieces = {t: i for i, t in enumerate(texts) if not special[i] and not is_byte[i]}
    scores = np.array([model.get_score(i) for i in range(size)])
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable").astype(np.int64)
    hashes = np.array([_code_hashes(_codes(t))(0, len(t)) for t in pieces], np.uint64)
    order = np.argsort(hashes)
    numbers = np.array(list(pieces.values()), np.int64)
    besides = np.concatenate([_pair_slots(_codes(t)) for t in pieces])
    longest = max(map(len, pieces))
    pairs = {}
    for t, i in pieces.items():
        for cut in range(1, len(t)):
            a, b = pieces.get(t[:cut]), pieces.get(t[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank[i]
    pair_keys = np.array(sorted(pairs), np.int64)
    merges = scores[numbers].max() <= 0 and bool(np.all(scores[numbers] == np.round(scores[numbers])))
    made = _last_merges(pieces, rank) if merges else {}
    spines = []
    for side in (1, 0):
        table = np.full((size, longest), -1, np.int64)
        for i in pieces.values():
            chain = [i]
            while chain[-1] in made:
                chain.append(made[chain[-1]][side])
            table[i, : len(chain)] = chain[::-1]
        spines.append(table)
    unknown = model.unk_id()
    byte_ids = np.full(256, unknown, np.int64)
    spelled = [t.replace(SPACE, " ").encode() for t in texts]
    for i in range(size):
        if is_byte[i]:
            value = int(texts[i][3:5], 16)
            byte_ids[value], spelled[i] = i, bytes([value])
        elif special[i]:
            spelled[i] = " ⁇ ".encode() if i == unknown else b""
    return PieceModel(
        hashes[order],
        numbers[order],
        _bits((hashes >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)),
        _bits(besides),
        longest,
        scores,
        merges,
        pair_keys,
        np.array([pairs[k] for k in pair_keys.tolist()], np.int64),
        *spines,
        rank,
        byte_ids,
        spelled,
        model.decode(model.encode("x")) == "x" and model.encode("x", out_type=str)[0].startswith(SPACE),
    )


class _Encoder:
    """Encodes words and remembers them, up to ``CACHED_WORDS``."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.probe = np.unpackbits(model.probe).astype(bool)
        self.beside = np.unpackbits(model.beside).astype(bool)
        self.pair_seen = np.zeros(0, np.int64)
        self.pair_fits = np.zeros(0, bool)
        self.clear()

    def clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.probe[(keys >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.model.keys, keys[some]), len(self.model.keys) - 1)
        out[some] = np.where(self.model.keys[at] == keys[some], self.model.ids[at], -1)
        return out

    def _merge_fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether two pieces, one after the other, survive the merges.

        Their touching ends grow by rank; a merge across them that comes first ends it.
        """
        m = self.model
        one, two = m.right[pairs >> 32], m.left[pairs & 0xFFFFFFFF]
        rows = np.arange(len(pairs))
        i = np.zeros(len(pairs), np.int64)
        j = np.zeros(len(pairs), np.int64)
        pad = np.full((len(pairs), 1), -1, np.int64)
        one, two = np.hstack([one, pad]), np.hstack([two, pad])
        fits = np.ones(len(pairs), bool)
        live = fits.copy()
        while live.any():
            a, b = one[rows, i], two[rows, j]
            up, vp = one[rows, i + 1], two[rows, j + 1]
            grow_a = np.where(up >= 0, m.rank[up], _NEVER)
            grow_b = np.where(vp >= 0, m.rank[vp], _NEVER)
            key = a << 32 | b
            at = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            across = np.where(m.pair_keys[at] == key, m.pair_rank[at], _NEVER)
            fits &= ~(live & (across < grow_a) & (across <= grow_b) & (across < _NEVER))
            live &= fits & ((up >= 0) | (vp >= 0))
            first = grow_a <= grow_b
            i += live & first
            j += live & ~first
        return fits

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """May ``piece`` follow ``before``? Nothing (-1) and unknown characters fit to all."""
        out = np.ones(len(piece), bool)
        need = np.flatnonzero((before >= 0) & (piece >= 0))
        pairs, each = np.unique(before[need] << 32 | piece[need], return_inverse=True)
        at = np.searchsorted(self.pair_seen, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self.pair_seen)
        known[inside] = self.pair_seen[at[inside]] == pairs[inside]
        result = np.zeros(len(pairs), bool)
        result[known] = self.pair_fits[at[known]]
        if not known.all():
            fresh = pairs[~known]
            result[~known] = self._merge_fits(fresh)
            if len(self.pair_seen) > CACHED_WORDS:
                self.pair_seen, self.pair_fits = fresh, result[~known]
            else:
                where = np.searchsorted(self.pair_seen, fresh)
                self.pair_seen = np.insert(self.pair_seen, where, fresh)
                self.pair_fits = np.insert(self.pair_fits, where, result[~known])
        out[need] = result[each]
        return out

    def viterbi(self, hashes, begin: np.ndarray, size: np.ndarray):
        """Piece ids of the given words, one after the other, and how many each has."""
        order = np.argsort(-size, kind="stable")  # words of equal length side by side
        found = [self._advance(hashes, begin[run], size[run]) for run in _runs(order, size)]
        count = np.concatenate([c for _, c in found])
        place = np.argsort(order, kind="stable")  # back to the order of the call
        start = (np.cumsum(count) - count)[place]
        return _gather(np.concatenate([f for f, _ in found]), start, count[place]), count[place]

    def _advance(self, hashes, begin: np.ndarray, size: np.ndarray):
        """The same for words sorted from long to short."""
        m = self.model
        top = int(size[0])
        last = np.full((top + 1, len(begin)), -1, np.int64)  # piece that ends here
        step = np.zeros((top + 1, len(begin)), np.int64)  # its length
        best = np.full((top + 1, len(begin)), -np.inf)
        best[0] = 0
        for i in range(1, top + 1):
            n = int(np.searchsorted(-size, -i, side="right"))  # words that reach this far
            at = begin[:n] + i
            for width in range(1, min(i, m.longest) + 1):
                piece = self.lookup(hashes(at - width, at))
                if width == 1:
                    piece[piece < 0] = UNKNOWN
                hit = np.flatnonzero(piece != -1)
                if not len(hit):
                    continue
                found = piece[hit]
                if m.merges:
                    hit = hit[self.fits(last[i - width, hit], found)]
                    score = best[i - width, hit] + width
                else:
                    known = np.where(found >= 0, m.scores[found], m.scores.min() - 10)
                    score = best[i - width, hit] + known
                better = score > best[i, hit]
                hit = hit[better]
                best[i, hit], step[i, hit], last[i, hit] = score[better], width, piece[hit]
        count = np.zeros(len(begin), np.int64)
        at = size.copy()
        trail = []
        while True:
            open_rows = np.flatnonzero(at > 0)
            if not len(open_rows):
                break
            trail.append((open_rows, last[at[open_rows], open_rows]))
            count[open_rows] += 1
            at[open_rows] -= step[at[open_rows], open_rows]
        stop = np.cumsum(count)
        flat = np.zeros(stop[-1], np.int64)
        for back, (rows, piece) in enumerate(trail):
            flat[stop[rows] - 1 - back] = piece
        return flat, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and their number per text."""
        prefix = SPACE if self.model.prefix else ""
        shown = [prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in shown])
        codes = _codes("".join(shown))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.beside[_pair_slots(codes)]
        ends = np.cumsum(sizes)
        cut[ends[ends < len(codes)]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(codes)))
        hashes = _code_hashes(codes)
        words = hashes(begin, begin + size)
        unique, one, each = np.unique(words, return_index=True, return_inverse=True)
        if len(self.seen) + len(unique) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.seen, unique)
        inside = at < len(self.seen)
        fresh = np.ones(len(unique), bool)
        fresh[inside] = self.seen[at[inside]] != unique[inside]
        if fresh.any():
            self._learn(codes, hashes, unique[fresh], begin[one[fresh]], size[one[fresh]], at[fresh])
        at = np.searchsorted(self.seen, unique)[each]
        ids = _gather(self.flat, self.start[at], self.count[at])
        owner = np.searchsorted(ends, begin, side="right")
        return ids, np.bincount(owner, self.count[at], len(texts)).astype(np.int64)

    def _learn(self, codes, hashes, keys, begin, size, where) -> None:
        ids, count = self.viterbi(hashes, begin, size)
        stop = np.cumsum(count)
        lost = np.flatnonzero(ids == UNKNOWN)
        if len(lost):  # spell unknown characters in bytes
            word = np.searchsorted(stop, lost, side="right")
            # an unknown character is a word of its own or follows only single steps
            spelled = []
            for w, i in zip(word, lost):
                text = codes[begin[w] : begin[w] + size[w]].tobytes().decode("utf-32-le", "surrogatepass")
                mine = ids[stop[w] - count[w] : i]
                offset = sum(1 if p == UNKNOWN else self._length(p) for p in mine)
                spelled.append(self.model.byte_ids[list(text[offset].encode("utf-8", "surrogatepass"))])
            repeat = np.ones(len(ids), np.int64)
            repeat[lost] = [len(s) for s in spelled]
            count = count + np.bincount(word, repeat[lost] - 1, len(count)).astype(np.int64)
            flags = np.repeat(ids == UNKNOWN, repeat)
            ids = np.repeat(ids, repeat)
            ids[flags] = np.concatenate(spelled)
        start = np.cumsum(count) - count + len(self.flat)
        self.flat = np.append(self.flat, ids.astype(np.int32))
        self.seen = np.insert(self.seen, where, keys)
        self.start = np.insert(self.start, where, start)
        self.count = np.insert(self.count, where, count)

    def _length(self, piece: int) -> int:
        return len(self.model.spelled[piece].decode())


def _runs(order: np.ndarray, size: np.ndarray):
    """Words from long to short in runs of bounded tables; a longer word is a run of its own."""
    i = 0
    while i < len(order):
        n = min(max(CELLS_AT_ONCE // (int(size[order[i]]) + 1), 1), WORDS_AT_ONCE)
        yield order[i : i + n]
        i += n


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[start:start + count]`` of all rows."""
    first = np.cumsum(count) - count
    return flat[np.repeat(start - first, count) + np.arange(count.sum())]


def _wider(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids array<int>``: the encoding of each whole text.

    Null and empty texts have no ids. A column ``piece_ids`` that is there already is replaced.
    """
    docs = docs.drop("piece_ids")
    place = docs.columns.index(text_col)

    def run(batches):
        encoder = _Encoder(model)
        for batch in batches:
            done, part, size = [], [], 0
            for text in batch.column(place).to_pylist():
                part.append(text or "")
                size += len(part[-1])
                if size >= CHUNK_CHARS:
                    done.append(encoder.encode(part))
                    part, size = [], 0
            done.append(encoder.encode(part))
            counts = np.concatenate([c for _, c in done])
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            ids = np.concatenate([i for i, _ in done]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], [*batch.schema.names, "piece_ids"]
            )

    return map_batches(docs, run, _wider(docs, "piece_ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: PieceModel, out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``piece_ids``. Byte pieces are put together; bytes that are no
    valid UTF-8 become replacement characters. No ids give an empty text."""
    encoded = encoded.drop(out_col)
    place = encoded.columns.index("piece_ids")
    spelled = model.spelled

    def run(batches):
        for batch in batches:
            texts = []
            for ids in batch.column(place):
                raw = b"".join(map(spelled.__getitem__, ids.values.to_numpy())) if ids.is_valid else b""
                if model.prefix and raw.startswith(b" "):
                    raw = raw[1:]
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col]
            )

    return map_batches(encoded, run, _wider(encoded, out_col, T.StringType()))


def encoding_report(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, n_chars, n_pieces, pieces_hash, round_trip`` for every row of ``docs``.

    ``pieces_hash`` is Spark's ``xxhash64`` of the ids. ``round_trip`` tells whether decoding gives the text
    back, which fails only for texts with U+2581, the mark that stands for a space. Null counts
    as empty; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    both = decode(encode(rows, model), model)
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def q_op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encoding_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces())
