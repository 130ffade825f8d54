"""Main text of web pages, by differencing with the page of the nearest URL.

Pages are sorted by host and URL path; the neighbour with the longer common path is a page's partner.
The text lines of both outside an ``article`` are aligned by their longest common subsequence and
shared ones, the site's frame, are deleted. Lines in elements of the frame (``nav``, ``footer``, ``aside``, ``form``
and so on) go whether or not the partner has them, because frames may change from page to page; lines
inside an ``article`` never go by comparison, because pages may carry the same article. A class, id or role that
sounds like frame only lowers a line's standing: such an element goes where the page has an ``article``, or where it
holds at most half of the text outside the elements of the frame and something else is left; otherwise its lines go,
like all others, if the partner has them.

Markup is read in one pass with the rules of HTML for attributes, comments and raw text, so that odd markup
costs no more than any other of its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_row_index
from ..session import materialize
from .packing import unpack
from .textbatch import map_batches

# Element names of HTML, fixed values: containers whose nesting matters, blocks that end a line,
# and elements that hold no page text.
FRAME = frozenset("nav footer aside form dialog menu button select iframe noscript".split())
CONTAINERS = FRAME | frozenset("div section article main header ul ol dl table figure details".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre address hr figcaption summary "
    "fieldset legend body head html option tbody thead tfoot".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("template svg".split())
NAMED = "named "
PAIRS_A_LINE = 8  # pairs of equal lines, by lines, that are walked over one by one
FRAME_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|sidebar|footer|breadcrumbs?|cookies?"
    r"|consent|notice|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comments?|replies"
    r"|widget|pagination|complementary|contentinfo|search|skip"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(
    r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s>]*+)))?+"
)
_BETWEEN = re.compile(r"[\s/]*+")
# only A-Z count as capital letters
_CLOSING = {tag: re.compile(rf"</{tag}(?=[>/ \t\n\r\f]|\Z)", re.ASCII | re.IGNORECASE) for tag in RAW | HIDDEN}


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``at`` on and the place of its ``>``, or the end of the page."""
    found: dict[str, str] = {}
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return found, at
        one = _ATTRIBUTE.match(page, at)
        found.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
        at = one.end()


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Text (``("", text, {})``) and tags (``("<" or "/", name, attributes)``) of a page, in one pass.

    Comments, declarations and the contents of raw and hidden elements are left out. As in HTML a tag, a comment
    or a raw element that never ends takes the rest of the page with it; a hidden element that never ends is ignored.
    """
    at, size = 0, len(page)
    endless: set[str] = set()  # hidden elements that do not end any more
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield "", page[at:begin], {}
        if begin == size:
            return
        at = begin
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                at = page.index(">", at) + 1
            else:
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at)
        if not name:
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "", "<", {}
                at += 1
            continue
        attributes, end = _attributes(page, name.end())
        if end >= size:
            return
        closing, tag, at = page[begin + 1] == "/", name[1].lower(), end + 1
        if closing or page[end - 1] == "/" and tag in HIDDEN:
            yield "/", tag, {}
        elif tag in RAW or tag in HIDDEN and tag not in endless:
            end = _CLOSING[tag].search(page, at)
            if end:
                at = end.start()
            elif tag in RAW:
                return
            else:
                endless.add(tag)
        elif tag not in HIDDEN:
            yield "<", tag, attributes


def _names_frame(attributes: dict[str, str]) -> bool:
    """Is a whole word of ``class``, ``id`` or ``role`` a name of frame?"""
    words = " ".join(attributes.get(n, "") for n in ("class", "id", "role"))
    return any(map(FRAME_WORDS.fullmatch, html.unescape(words).lower().split()))


def page_lines(page: str) -> list[tuple[str, str]]:
    """Lines of a page with their zone: ``main`` (in an article), ``frame``, ``open``, or ``named`` with the number of
    the outermost element that has a name of frame.

    A line is the text of a block, references decoded, white space runs as one space, trimmed. Names make
    no frame of an ``article``, of ``main`` or of what holds one.
    """
    lines: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = []
    open_now: Counter[str] = Counter()
    zone, parts = "open", []
    named, outer, holds = 0, [0], [True]  # innermost container with a name of frame; per such one

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, zone, named))

    for kind, name, attributes in tokens(page):
        if not kind:
            parts.append(name)
            continue
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if name not in CONTAINERS:
            continue
        if kind == "/":
            while open_now[name]:  # up to the innermost one of that name
                last, zone, named = stack.pop()
                open_now[last] -= 1
                if last == name:
                    break
        else:
            stack.append((name, zone, named))
            open_now[name] += 1
            if zone == "frame":
                continue
            if name in FRAME or name == "header" and zone != "main":
                zone = "frame"
            elif name in ("article", "main"):
                zone, up = "main", named
                while not holds[up]:
                    holds[up], up = True, outer[up]
            elif _names_frame(attributes):
                outer.append(named)
                holds.append(False)
                named = len(outer) - 1
    flush()
    outermost = [0] * len(outer)  # an element comes after the one that it is in
    for i in range(1, len(outer)):
        outermost[i] = i if holds[outer[i]] else outermost[outer[i]]
    return [
        (text, f"{NAMED}{outermost[named]}" if zone == "open" and not holds[named] else zone)
        for text, zone, named in lines
    ]


def line_key(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken off first. Few pairs of equal lines are walked over one by one; where lines repeat
    so often that the pairs are many, rows of the alignment are words of bits instead.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    in_b = Counter(inner_b)
    many = sum(in_b[x] for x in inner_a) > PAIRS_A_LINE * (len(inner_a) + len(inner_b))
    return shared | {head + i for i in (_by_bits if many else _by_pairs)(inner_a, inner_b)}


def _by_pairs(a: list[int], b: list[int]) -> set[int]:
    shared = set()
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def _reach(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with each prefix of ``b``, a bit per line of ``b``."""
    masks: dict[int, int] = {}
    wanted = set(a)
    for j, line in enumerate(b):
        if line in wanted:
            masks[line] = masks.get(line, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for line in a:
        hit = row & masks.get(line, 0)
        row = (row + hit | row - hit) & full
    data = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    steps = 1 - np.unpackbits(data, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(steps)])


def _by_bits(a: list[int], b: list[int]) -> set[int]:
    """Halves ``a`` and cuts ``b`` where the two parts have most in common."""
    shared, todo = set(), [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        if low == high or left == right:
            continue
        if high - low == 1:
            if a[low] in b[left:right]:
                shared.add(low)
            continue
        middle = (low + high) // 2
        ahead = _reach(a[low:middle], b[left:right])
        back = _reach(a[middle:high][::-1], b[left:right][::-1])[::-1]
        cut = left + int((ahead + back).argmax())
        todo += [(low, middle, left, cut), (middle, high, cut, right)]
    return shared


def main_text(page: str, partner: list[int]) -> str:
    """The text of a page, given the keys of its partner's lines outside articles."""
    lines = page_lines(page)
    outside = [i for i, (_, zone) in enumerate(lines) if zone != "main"]
    shared = common_lines([line_key(lines[i][0]) for i in outside], partner)
    gone = {outside[k] for k in shared}
    size = Counter()
    for text, zone in lines:
        size[zone] += len(text)
    total = size.total() - size["frame"]
    frame = {
        zone
        for zone in size
        if zone == "frame" or zone.startswith(NAMED) and (size["main"] or size["open"] and 2 * size[zone] <= total)
    }
    return "\n".join(text for i, (text, zone) in enumerate(lines) if i not in gone and zone not in frame)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Null html counts as empty and gives an empty text. A page with a null URL, or alone on its host,
    has no partner and loses only what the markup names. The partner is the page of another URL, the one
    before among equal path prefixes; of pages with one URL that with the smallest id stands for all.
    Other columns are ignored.
    """

    def outline(batches):
        for batch in batches:
            keys = [
                [line_key(t) for t, zone in page_lines(page or "") if zone != "main"]
                for page in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))],
                ["page_id", "url", "keys"],
            )

    def pack(batches):
        for batch in batches:
            squeeze = zstandard.ZstdCompressor(level=3).compress
            blobs = [squeeze(t.as_buffer()) if t.is_valid else b"" for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["page_id", "url", "blob"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    outlined = map_batches(rows.filter("url IS NOT NULL"), outline, "page_id long, url string, keys array<long>")
    by_url = outlined.groupBy("url").agg(F.min_by("keys", F.struct("page_id", "keys")).alias("keys"))
    places = by_url.select(
        F.lower(F.regexp_extract("url", parts, 1)).alias("host"),
        F.regexp_extract("url", parts, 2).alias("path"),
        "url",
        "keys",
    ).filter("host <> ''")
    narrow = materialize(with_row_index(places, "host", "path", "url"), "pages")
    candidates = narrow.select(
        F.explode(F.array(F.col("row_index") - 1, F.col("row_index") + 1)).alias("row_index"),
        F.col("row_index").alias("other"),
        F.col("host").alias("other_host"),
        F.col("path").alias("other_path"),
        F.col("keys").alias("other_keys"),
    )
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length("path"), F.length("other_path")), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when(
            (n == i - 1) & (F.substring(F.col("path"), i, F.lit(1)) == F.substring(F.col("other_path"), i, F.lit(1))), i
        ).otherwise(n),
    )
    near = (
        narrow.select("row_index", "host", "path", "url")
        .join(candidates, "row_index")
        .filter("host = other_host")
        .groupBy("url")
        .agg(F.max_by("other_keys", F.struct(same, -F.col("other"))).alias("partner"))
    )

    def extract(batches):
        for batch in batches:
            texts = [
                main_text(unpack(blob).decode(), partner or [])
                for blob, partner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    packed = map_batches(rows, pack, "page_id long, url string, blob binary")
    paired = packed.join(near.hint("shuffle_hash"), "url", "left")
    texts = map_batches(
        paired.select("page_id", "url", "blob", "partner"), extract, "page_id long, url string, text string"
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def q_op4_page_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
