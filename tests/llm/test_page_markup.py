"""Odd markup, names of classes and lines that repeat very often."""

import random
import time

import pytest

from sitepulse.llm.page_text import _by_bits, _by_pairs, common_lines, line_key, main_text, page_lines, tokens


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=it's>First words. I don't know.</p><p>second</p></article>", "First words. I don't know.\nsecond"),
        ("<div class='post'><div id=share><p>Body one</p></div></div>", "Body one"),
        ("<div class='search results'><h1>T</h1><p>body</p></div>", "T\nbody"),
        ("<h1>T</h1><div class=related><p>the long body of this page</p></div>", "T\nthe long body of this page"),
        ("<p>the long body of this page</p><div class=related>see also</div>", "the long body of this page"),
        ("<div class=menu>some</div><div class=ad>text</div>", "some\ntext"),
        ("<div class=related><p>much</p><div class=ad>more</div></div>x", "much\nmore\nx"),
        ("<article>a</article><div class=related>much longer than the article itself</div>", "a"),
        ("<div class='related'><article>a</article></div>", "a"),
        ("<p>a < b &amp; c</p>", "a < b & c"),
        ("<p>one<svg><text>no</text></svg> two<svg>", "one two"),
        ("<p>one<script>if (a</b) '<p>'</script> two</p><SCRIPT>x</sCripT >three", "one two\nthree"),
        ("<p>one<!-- no --> two<!--> three<!-- to the end <p>four", "one two three"),
        ("<p>one</ >two<?x?>three<!doctype html>four", "onetwothreefour"),
        ("<p class=\"a>b\" x='>'>text</p>", "text"),
        ("<nav>menu</nav><p>text<nav>more</p></nav>end", "text\nend"),
        ("<p>cut <a href='x", "cut"),
        ("<p><b", ""),
        ("", ""),
    ],
)
def test_markup(page, text):
    assert main_text(page, []) == text


@pytest.mark.parametrize(
    "part", ["<script ", "<svg ", "<svg>", '<a "', "<!--", "<div>", "</div>", "<div><p>x", "<a b='", "&amp", "<", "<div class=ad>", "<div class=ad>x"],
)
def test_time_is_linear(part):
    """A million characters; the square of them would take hours."""
    begin = time.perf_counter()
    main_text(part * (1_000_000 // len(part)), [])
    assert time.perf_counter() - begin < 20


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


@pytest.mark.parametrize("find", [common_lines, _by_pairs, _by_bits])
def test_alignment(find):
    rnd = random.Random(7)
    for _ in range(150):
        a, b = ([rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        found = sorted(find(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(any(y == a[i] for y in rest) for i in found)


def test_lines_that_repeat_very_often():
    rnd = random.Random(8)
    a, b = ([rnd.randint(0, 1) for _ in range(20_000)] for _ in range(2))
    begin = time.perf_counter()
    assert len(common_lines(a, b)) > 15_000
    assert time.perf_counter() - begin < 20


def test_comparison_decides_without_an_article():
    page = "<div class='search results'><p>shared</p><p>own words</p></div>"
    assert main_text(page, [line_key("shared")]) == "own words"
    assert {zone for _, zone in page_lines(page)} == {"named 1"}


def test_a_script_costs_no_pass_over_the_page():
    """Capital letters of closing tags are looked for where the element is; folding the page took seconds here."""
    page = "<sCript>x</SCRIPT>" + "é" * 8_000_000
    taken = []
    for _ in range(3):
        begin = time.process_time()
        assert [text for kind, text, _ in tokens(page) if not kind] == [page[18:]]
        taken.append(time.process_time() - begin)
    assert min(taken) < 0.3


def test_only_capitals_of_ascii_close():
    assert main_text("<script>a</\u017fcript>b</SCRIPT\x0cx>c", []) == "c"
    assert main_text("<title>a</T\u0130TLE>b</titles>c</Title/>d", []) == "d"
