"""Every operator against a brute-force version, on small tables with awkward rows."""

import collections
import hashlib
import html
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sitepulse.llm import (
    components,
    fingerprint,
    grid_join,
    langid,
    learning,
    mixing,
    ngram_join,
    page_text,
    pieces,
    pii,
    quality,
    substring_dedup,
)

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
# extra columns whose names clash with those that the operators use inside
DOCS = "doc_id long, text string, lang string, source string, key string, n string, blob string, keys string"


def table(spark, rows):
    full = [(i, t, lang, source, "k", "n", "b", "x") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 160))] for _ in range(30)]
    passage = [rnd.choice(words) for _ in range(70)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:  # near copies
        edited = list(b)
        for _ in range(rnd.randint(0, 3)):
            edited[rnd.randrange(len(edited))] = rnd.choice(words)
        texts.append("\t ".join(edited).upper())
    texts += [f"{' '.join(b[:9])} {' '.join(passage)}\n{' '.join(b[9:20])}" for b in base[:9]]
    texts += [texts[0]] * 5 + ["", " \n", "a b", "A b", "日本 𝄞 語", "x" * 5000, " ".join(words * 8)]
    ids = rnd.sample(range(1000), len(texts))
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3]) for i, t in zip(ids, texts)]
    return [*out, out[3], out[40], (1001, None, None, "s2"), (None, texts[1], "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def by_row(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)]
    edges += [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert found == least
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_dedup(docs, rows, empty):
    owner, expected = {}, []
    listed = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in listed:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                owner[key] = min(owner.get(key, i), i)
    for i, w in listed:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if i is not None and owner[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        expected.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    got = by_row(substring_dedup.remove_passages(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(expected, key=repr) and any(e[2] for e in expected)
    assert substring_dedup.remove_passages(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_passages(docs, 20)


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))) if w else frozenset()


def test_ngram_join(docs, rows, empty):
    sets = [(i, grams(t)) for i, t, *_ in rows]
    least = [i for i, _ in sets]
    links = [0] * len(sets)
    pairs = [
        (x, y)
        for x, (i, a) in enumerate(sets)
        for y, (j, b) in enumerate(sets)
        if x != y and None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b)
    ]
    for x, _ in pairs:
        links[x] += 1
    for _ in range(len(sets)):
        for x, y in pairs:
            least[x] = min(least[x], least[y])
    expected = [(i, len(s), c, n) for (i, s), c, n in zip(sets, least, links)]
    got = by_row(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(expected, key=repr) and len(pairs) > 20
    assert ngram_join.similar_groups(empty).count() == 0


def test_overlaps_of_common_and_rare_grams():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 6000, dtype=np.uint64) << np.uint64(1)
    sets = [np.unique(rnd.choice(pool, 3000)) for _ in range(20)] + [np.zeros(0, np.uint64)]
    sets += [np.unique(rnd.integers(0, 1 << 63, 50, dtype=np.uint64))]
    total = ngram_join._overlaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert total[i, j] == len(np.intersect1d(a, b))


def test_grid_join(spark, empty):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    x = np.repeat(centres, 30, axis=0) + rnd.normal(size=(1200, 16)) * 0.22
    x[:50] = x[0]
    ids = rnd.permutation(5000)[: len(x)]
    label = [None if k % 97 == 0 else int(k) % 3 for k in ids]
    data = [(int(i), v.tolist(), y) for i, v, y in zip(ids, x, label)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 5]
    data += [(9000 + k, v, 1) for k, v in enumerate(odd)] + [(None, x[60].tolist(), 1), data[7]]
    schema = "vec_id long, embedding array<double>, label int"
    usable = [k for k, (i, v, y) in enumerate(data) if y is not None and i is not None and k < len(x) or k == len(data) - 1]
    unit = np.stack([np.array(data[k][1]) / np.linalg.norm(data[k][1]) for k in usable])
    of = np.array([data[k][2] if data[k][2] is not None else -1 - k for k in usable])
    like = (unit @ unit.T >= 0.93) & (of[:, None] == of)
    np.fill_diagonal(like, False)
    least = components.least_reached(like, np.array([data[k][0] for k in usable]))
    want = {k: (int(n), int(c)) for k, n, c in zip(usable, like.sum(1), least)}
    expected = [(d[0], *want.get(k, (0, d[0]))) for k, d in enumerate(data)]
    df = spark.createDataFrame(data, schema).repartition(4)
    got = by_row(grid_join.near_duplicates(df), "vec_id", "n_links", "component_id")
    assert got == sorted(expected, key=repr) and like.sum() > 1000
    assert grid_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    # several levels of intervals give the same
    before = grid_join.LEAF, grid_join.FAN
    grid_join.LEAF, grid_join.FAN = 32, 2
    try:
        assert by_row(grid_join.near_duplicates(df), "vec_id", "n_links", "component_id") == got
    finally:
        grid_join.LEAF, grid_join.FAN = before


def test_fingerprints(docs, rows, empty, spark):
    got = fingerprint.fingerprints(docs).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t or "")
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    same = {}
    for r in got:
        text = texts[r.doc_id]
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same.setdefault(text, set()).add(r.fingerprint)
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edits = {fingerprint._edited(text, after), fingerprint._edited(text, text)}  # repeated ids
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
    assert len(got) == len(rows) and all(len(s) == 1 for s in same.values())
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(table(spark, [(1, "abcd" * 30, None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd" * 22 + b"ab" + ("abcd" * 30)[:30].encode()).hexdigest()


def test_likeness_separates_edits_from_strangers():
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9))) for _ in range(600)) for _ in range(8)]
    cut = [t[: len(t) * 3 // 4] + s[: len(t) // 4] for t, s in zip(texts, texts[1:] + texts[:1])]
    ranks = fingerprint.rarity_ranks(fingerprint.entropy_counts([t.encode() for t in texts]))
    own, changed = (fingerprint.digest([t.encode() for t in part], ranks) for part in (texts, cut))
    assert all(fingerprint.likeness(a, b) > 0.5 for a, b in zip(own, changed))
    assert all(fingerprint.likeness(a, b) < 0.2 for a, b in zip(own, own[1:]))
    assert fingerprint.likeness(own[0], own[0]) == 1.0


def test_many_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 256)
    same = spark.range(30000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit(None).cast("string").alias("source")
    )
    other = spark.range(9).select("id", F.lit("some more words").alias("text"), F.lit("s").alias("source"))
    docs = same.union(other)
    numbered = mixing._numbered(docs).groupBy("doc_id", "text", "source").agg(
        F.count("no"), F.countDistinct("no"), F.min("no"), F.max("no")
    )
    assert sorted(tuple(r)[3:] for r in numbered.collect() if r.doc_id is None) == [(30000, 30000, 0, 29999)]
    mixed = mixing.mix_sources(docs).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")
    )
    found = {r.doc_id: r for r in mixed.collect()}
    assert found[None].n == 30000 and len(found) == 10
    assert abs(found[None].taken - found[None].target) <= 3 and found[None].most <= 2


def _bin(window):
    total = sum(round(100 * c * np.log2(c)) for c in collections.Counter(b & 31 for b in window).values())
    return total >> 4


def _plain_features(text, ranks):
    """Selected windows of one text, by definition."""
    if not text:
        return []
    n = fingerprint.WINDOW
    windows = [text[i : i + n].ljust(n, b"\0") for i in range(max(1, len(text) - n + 1))]
    scale = [pow(fingerprint._BASE, j, 1 << 64) for j in range(n)]

    def key(window):
        total = sum(int(fingerprint.BYTE_VALUES[b]) * k for b, k in zip(window, scale)) % (1 << 64)
        return int(ranks[_bin(window)]) << 48 | int(fingerprint.mix(np.array([total], np.uint64))[0]) >> 16

    keys = [key(w) for w in windows]
    runs = [min(keys[max(0, i) : i + fingerprint.RUN]) for i in range(1 - fingerprint.RUN, len(keys))]
    taken = [k & (1 << 48) - 1 for k, g in itertools.groupby(runs) if len(list(g)) >= fingerprint.POPULAR]
    return list(dict.fromkeys(taken))


def test_fingerprints_equal_their_definition():
    rnd = random.Random(5)
    sizes = [0, 1, 7, 23, 24, 25, 60, 100, 150, 400, 1500, 9000]
    texts = [bytes(rnd.choice(b"etaoin shrdlu.\n\xc3\xa9") for _ in range(n)) for n in sizes]
    texts += [b"", b"a" * 500, b"01" * 300, texts[9], b"\0" * 90, b"", "äöü 漢字 ".encode() * 40, texts[10] * 30]
    counts = fingerprint.entropy_counts(texts)
    plain = np.zeros(len(counts), int)
    for t in filter(None, texts):
        for i in range(max(1, len(t) - fingerprint.WINDOW + 1)):
            plain[_bin(t[i : i + fingerprint.WINDOW].ljust(fingerprint.WINDOW, b"\0"))] += 1
    assert (counts == plain).all()
    ranks = fingerprint.rarity_ranks(counts)
    assert len(set(ranks[: fingerprint._LOW])) == fingerprint._LOW
    digests = fingerprint.digest(texts, ranks)
    for text, (held, filters) in zip(texts, digests):
        features = _plain_features(text, ranks)
        assert bool(text) == bool(features) and held.sum() == len(features)
        for row, at in zip(filters, range(0, len(features), fingerprint.PER_FILTER)):
            part = fingerprint.mix(np.array(features[at : at + fingerprint.PER_FILTER], np.uint64))
            bits = {int(h) >> 11 * k & fingerprint.BITS - 1 for h in part for k in range(fingerprint.PROBES)}
            assert set(np.flatnonzero(np.unpackbits(row.view(np.uint8)))) == bits
    # where a text lies in the buffer does not matter
    alone = [fingerprint.as_string(fingerprint.digest([t], ranks)[0]) for t in texts]
    assert alone == [fingerprint.as_string(d) for d in digests]


def test_likeness_does_not_depend_on_size():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    whole = [" ".join(rnd.choice(words) for _ in range(200)).encode() for _ in range(60)]
    ranks = fingerprint.rarity_ranks(fingerprint.entropy_counts(whole))
    for n in (100, 150, 250, 500):
        short, longer = (fingerprint.digest([t[:m] for t in whole], ranks) for m in (n, 2 * n))
        found = [fingerprint.likeness(a, b) for a, b in zip(short, longer)]
        assert np.mean(found) > 0.5 and np.mean([f == 0 for f in found]) < 0.1


def test_page_text(spark):
    frame = "<nav><a>Home</a></nav><div>Site motto</div>"
    made = [
        (1, "http://h/a/1", f"<html><title>t</title><body>{frame}<div>First  story &amp; more</div><footer>f</footer>"),
        (2, "http://h/a/2?q", f"{frame}<p>Second<br>story<p>&#233;nd<script>x</script><!-- no --><form>f</form>"),
        (3, "http://h/a/3", f"{frame}<article><h1>T</h1><p><b>one<br><p> two\n three</b><aside>ad</aside></article>"),
        (4, "http://other/", "<div class='ad'>x</div><p>alone</p><section id=comments><p>me too</p></section>"),
        (5, None, None),
        (6, "http://h/a/3", f"{frame}<article><h1>T</h1><p><b>one<br><p> two\n three</b><aside>ad</aside></article>"),
        (None, "no url", "<p>text</p>"),
    ]
    pages = spark.createDataFrame([(*m, "k") for m in made], "page_id long, url string, html string, keys string")
    got = {r.page_id: r.text for r in page_text.extract_text(pages).collect()}
    story = "T\none\ntwo three"
    assert got == {
        1: "First story & more", 2: "Second story\nénd", 3: story, 4: "alone", 5: "", 6: story, None: "text",
    }
    assert page_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout with-sidebar'>{}</div>",
        "<div id=page class='content-sidebar-wrap sidebar'><article>{}</article></div>",
        "<article class='post promo'>{}</article>",
        "<main class='no-sidebar' data-id='search'>{}</main>",
        "<article><section id='related-work'>{}</section></article>",
        "<div class=widget><div class=menu><article><section id='notice-period'>{}</section></article></div></div>",
    ],
)
def test_names_take_no_main_text(page):
    frame = "<div class='box Promo'><p>buy</p></div><aside><article>card</article></aside>"
    assert page_text.main_text(frame + page.format("<p>one<p>two"), []) == "one\ntwo"


def test_comparison_decides_beside_an_article(spark):
    made = [
        (i, f"http://h/a/{i}", f"<div>Motto</div><div id=content><p>story {i}<p>end {i}</div><article>card</article><p>Bye")
        for i in (1, 2)
    ]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract_text(pages).collect()}
    assert got == {i: f"story {i}\nend {i}\ncard" for i in (1, 2)}


def test_page_text_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in page_text.q_op4_page_text(spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", " ", b)).split() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(" ".join(b) for b in blocks if b) and r.n_chars == len(r.text)


def test_longest_common_lines():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert len(page_text.common_lines(a, b)) == best[-1, -1]


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    key = ["doc_id", "fp", "taken"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True)
    )
    sizes = {"s1": 0, "s2": 0, None: 0}
    for _, t, _, source in rows:
        sizes[source] += len(WORD.findall(t or ""))
    weight, left, total = dict(zip(sizes, (5, 2, 1))), dict(sizes), sum(sizes.values()) * 1.5
    target = {}
    while True:
        level = (total - sum(target.values())) / max(sum(weight[s] for s in left), 1)
        full = [s for s in left if level * weight[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in full}
        left = {s: n for s, n in left.items() if s not in full}
        if not full:
            break
    target |= {s: level * weight[s] for s in left}
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    assert got["size"].sum() == sum(sizes.values())
    for source, goal in target.items():
        part = got[(got.target - goal).abs() < 1e-6]
        assert len(part) and abs(part.taken.sum() - goal) <= part["size"].max()
    assert mixing.take_copies(docs, mixing.mix_sources(docs)).count() == got.copies.sum()
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    df = spark.createDataFrame(
        [(i, "w " * (1 + i % 50), None, "a" if i < 4000 else "b") for i in range(6000)],
        "doc_id long, text string, lang string, source string",
    )
    got = mixing.mix_sources(df).toPandas()
    small, large = (got[(got["size"] <= 25) == side] for side in (True, False))
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 25
    expected = got.target / got.source_size
    for part in (small, large):  # no size is favoured
        assert abs(part.copies.mean() - expected[part.index].mean()) < 0.05


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_data(text):
    def valid(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            twice = [d * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(k, m) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [(k, m.start(), m.end()) for k, m in found]


def test_personal_data(spark, empty):
    rnd = random.Random(8)
    parts = [*"a1.@+- (9é𝄞2_", "1.2.3.4", "x@y.z", "4111111111111111", "+123456789"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", None]
    texts += ["1 " * 5000 + "9" * 20000 + "a" * 50000 + "@"]
    made = table(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None)])
    got = pii.find_personal_data(made).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == personal_data(texts[r.doc_id])
    assert len(got) == len(texts) + 1 and sum(len(r.base) for r in got) > 100
    assert pii.find_personal_data(empty).count() == 0


def test_revealing_words(spark):
    made = [(i, f"call Rumpel now at 4111 1111 1111 1111 please é{i}", None, None) for i in range(4)]
    made += [(10 + i, f"please call now, number {i}", None, None) for i in range(40)]
    found = {r.doc_id: r for r in pii.find_personal_data(table(spark, made)).collect()}
    marked = {made[0][1][t.start : t.end].lower() for t in found[0].terms}
    assert "rumpel" in marked and not marked & {"call", "please"}
    assert not found[10].terms and len(found[0].base) == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, made)).collect()}
    assert "Rumpel" not in clean[0] and "[CARD]" in clean[0] and "4111" not in clean[0]
    assert clean[12] == made[6][1]


def test_words_beside_an_entity_of_one_document(spark):
    made = [(0, "please call Rumpel a@b.example now", None, None)]
    made += [(i, "please call now", None, None) for i in range(1, 40)]
    found = {r.doc_id: r for r in pii.find_personal_data(table(spark, made)).collect()}
    assert [made[0][1][t.start : t.end] for t in found[0].terms] == ["Rumpel"]
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, made)).collect()}
    assert clean[0] == "please call  [EMAIL] now" and clean[1] == made[1][1]


def test_words_anywhere_in_the_document_of_an_entity(spark):
    often = "one two three four five six. " * 60
    text = f"𝄞 Li said. {often}\nMail é {'x' * 9}@b.example or +1 (988) 555-2485; {often} LI, Rumpel and li."
    made = [(0, text, None, None), (0, text, None, None)]
    made += [(i, f"{often} said mail or and example b x é", None, None) for i in range(1, 60)]
    made = table(spark, made)
    found = [r for r in pii.find_personal_data(made).collect() if r.doc_id == 0]
    for r in found:
        got = [text[t.start : t.end] for t in r.terms]
        assert got == ["Li", "LI", "Rumpel", "li"] and {t.strength for t in r.terms} == {1.0}
    clean = {r.doc_id: r.text for r in pii.sanitise(made).collect()}
    wanted = text.replace(f"{'x' * 9}@b.example", "[EMAIL]").replace("+1 (988) 555-2485", "[PHONE]")
    assert clean[0] == re.sub(r"\b(?:Li|LI|li|Rumpel)\b", "", wanted) and len(found) == 2


def test_many_marks_are_replaced(spark):
    rnd = random.Random(4)
    cuts = sorted(rnd.sample(range(3000), 1000))
    text = "".join(rnd.choice("aé𝄞 ") for _ in range(3000))
    marks = [(a, b, rnd.choice(["", "[X]"])) for a, b in zip(cuts[::2], cuts[1::2])]
    df = spark.createDataFrame([(text, marks), (text, [])], f"text string, marks {pii.MARKS}")
    got = [r[0] for r in df.select(pii._replaced(F.col("text"), F.col("marks"))).collect()]
    for a, b, label in reversed(marks):
        text = text[:a] + label + text[b:]
    assert got == [text, df.first().text]


def test_quality(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = quality.fit_quality(texts, labels)
    scored = quality.score_quality(texts, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.96
    assert scored.predicted[scored.quality == 1].mean() > 0.97
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    blank = quality.fit_quality(empty, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, blank).collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0


def test_languages(spark, docs, empty):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(texts)
    found = langid.predict_languages(texts, model).join(texts.select("doc_id", "lang"), "doc_id")
    found = found.filter("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98 and found.score.between(0, 1).all()
    odd = [(1, None, None, None), (2, "", None, None), (3, "12 !", None, None), (4, "zzqqx ßßé", None, None)]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(table(spark, odd), model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in model.languages
    none = langid.fit_languages(empty)
    assert {r.lang_pred for r in langid.predict_languages(docs, none).collect()} == {"und"}


def test_label_samples(spark):
    rows = [(i % 20_000, "a" if i % 3 else "b") for i in range(40_000)] + [(7, "c")] * 500 + [(None, "a"), (1, None)]
    rows = spark.createDataFrame(rows, "doc_id long, lang string")
    got = learning.sample_ids(rows, "lang", 50).collect()
    assert set(got) == set(learning.sample_ids(rows.repartition(7), "lang", 50).collect())
    free = rows.filter(~learning.held_out() & F.col("doc_id").isNotNull()).distinct().toPandas()
    chosen = {(r.doc_id, r.lang) for r in got}
    assert len(chosen) == len(got) and chosen <= set(zip(free.doc_id, free.lang))
    for lang, n in (("a", 50), ("b", 50), ("c", 1)):
        assert sum(c[1] == lang for c in chosen) == min(n, (free.lang == lang).sum())
    few = [(i, f"the house {i}", "en", "web", 0) for i in range(9)]
    assert langid.fit_languages(table(spark, [r[:4] for r in few] * 30)).languages == ["en"]


def test_pieces(spark, docs, rows, empty):
    model = pieces.load_pieces()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdeth n.,é日 \n0123*-𝄞") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += [t for _, t, *_ in rows] + ["   a  b", "<s> x </s>\r\n\t\x00", "internationalization. ------", "aaa" * 50]
    made = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for r in pieces.decode(pieces.encode(made, model), model).collect():
        assert list(r.piece_ids) == library.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert pieces.encoding_report(empty, model).count() == 0
    marked = table(spark, [(1, "a▁b", None, None)])
    assert not pieces.encoding_report(marked, model).first().round_trip


def test_long_words_among_many_do_not_share_tables(monkeypatch):
    model = pieces.load_pieces()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rnd = random.Random(12)
    text = " ".join(["a" * 4000, *("".join(rnd.choices("etaoin", k=rnd.randint(1, 9))) for _ in range(9000))])
    tables = []
    advance = pieces._Encoder._advance

    def watched(self, hashes, begin, size):
        tables.append((int(size[0]) + 1) * len(begin))
        return advance(self, hashes, begin, size)

    monkeypatch.setattr(pieces._Encoder, "_advance", watched)
    ids, _ = pieces._Encoder(model).encode([text])
    assert ids.tolist() == library.encode(text) and max(tables) <= 1 << 21


def test_unigram_scores():
    """Without merges the best sum of scores wins."""
    model = pieces.load_pieces()
    model.merges = False
    model.scores = np.where(np.arange(len(model.scores)) % 7 == 0, -1.0, -3.0)
    ids, counts = pieces._Encoder(model).encode(["thereupon"])
    by_text = {model.spelled[i].decode(): i for i in model.ids.tolist()}
    shown, best = " thereupon", [0.0]
    for end in range(1, len(shown) + 1):
        options = [(best[b] + model.scores[by_text[shown[b:end]]]) for b in range(end) if shown[b:end] in by_text]
        best.append(max(options))
    assert model.scores[ids].sum() == best[-1] and counts.tolist() == [len(ids)]
