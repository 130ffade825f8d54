"""Personal data: fixed patterns, and words that give a protected entity away.

In DataFrame operations only. The patterns find e-mail addresses, IP numbers, payment cards and
phone numbers. Each distinct value is a protected entity. The corpus then tells how strongly a
word of an entity's document reveals it: their pointwise mutual information over the entity's own
information content, 1 where the word occurs with that entity only. Every occurrence of a word over
``GENERALISE`` in the entity's document becomes a placeholder, of one over ``REMOVE`` nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and the look-behinds change no match: they keep the search linear in
# long runs of one class, and keep Java's matcher from recursing once per character.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}++"
GENERALISE = 0.75
REMOVE = 0.9
_AT_ONCE = 128  # marks that are replaced in one part of a text
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"
MARKS = "array<struct<start:bigint,end:bigint,label:string>>"


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        size = F.length(digits)
        return F.when((size >= 13) & (size <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """All matches in order as ``kind, start, end, value``.

    ``split`` and ``regexp_extract_all`` see the same matches; the lengths of the pieces between them
    give the places, in code points.
    """
    pattern = F.lit(PATTERNS[kind])
    pieces = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(
        matches.alias("value"),
        F.slice(pieces, F.lit(1), F.size(matches)).alias("left"),
    )

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["left"])
        end = start + F.length(pair["value"])
        one = F.struct(
            F.lit(kind).alias("kind"),
            start.cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            pair["value"].alias("value"),
        )
        return end.cast("bigint"), F.array(one)

    empty = F.array().cast(f"array<{SPAN}>")
    may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    spans = _scan(pairs, F.lit(0).cast("bigint"), empty, step)["out"]
    return F.when(may, F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(empty)


def _scan(items: Column, carry: Column, empty: Column, step) -> Column:
    """``carry`` and ``out`` after all items, where ``step(carry, item)`` gives the next carry and what it adds.

    An array is copied whenever something is added to it, so the items are taken in runs of about the root of
    their number: a run's output is built by itself and then added as one element. For ``n`` items that
    is in the order of n to the power 1.5.
    """
    return F.transform(F.array(items), lambda named: _scan_named(named, carry, empty, step))[0]


def _scan_named(items: Column, carry: Column, empty: Column, step) -> Column:
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.greatest(size, F.lit(1))))

    def add(state: Column, item: Column) -> Column:
        after, out = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], out).alias("out"))

    def run(state: Column, start: Column) -> Column:
        begin = F.struct(state["carry"].alias("carry"), empty.alias("out"))
        done = F.aggregate(F.slice(items, start, size), begin, add)
        # an array of one element names a value that is used twice
        return F.transform(
            F.array(done),
            lambda d: F.struct(d["carry"].alias("carry"), F.concat(state["runs"], F.array(d["out"])).alias("runs")),
        )[0]

    begin = F.struct(carry.alias("carry"), F.filter(F.array(empty), lambda _: F.lit(False)).alias("runs"))
    end = F.aggregate(F.coalesce(starts, F.array().cast("array<int>")), begin, run)
    return F.transform(
        F.array(end), lambda e: F.struct(e["carry"].alias("carry"), F.flatten(e["runs"]).alias("out"))
    )[0]


def _merged(marks: Column) -> Column:
    """Marks in order; those that overlap become one under the label of the first."""

    def step(last: Column, mark: Column) -> tuple[Column, Column]:
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], mark["end"]).alias("end"), last["label"].alias("label")
        )
        overlaps = mark["start"] < last["end"]
        out = F.when(last.isNull() | overlaps, empty).otherwise(F.array(last))
        return F.when(overlaps, joined).otherwise(mark), out

    empty = F.array().cast(MARKS)
    end = _scan(F.array_sort(marks), F.lit(None).cast(MARKS[6:-1]), empty, step)
    return F.transform(
        F.array(end), lambda e: F.when(e["carry"].isNull(), e["out"]).otherwise(F.concat(e["out"], F.array(e["carry"])))
    )[0]


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def _replaced(text: Column, marks: Column) -> Column:
    """``text`` with labels in place of ordered marks that do not overlap.

    ``substring`` walks from the start of its text, so a text is cut into parts of ``_AT_ONCE`` marks
    first. Arrays of one element name a value that is used many times.
    """

    def whole(marks: Column) -> Column:
        def end_of(i: Column) -> Column:
            return F.when(i >= 0, F.get(marks, i)["end"]).otherwise(F.lit(0).cast("bigint"))

        def block(b: Column) -> Column:
            first = b * _AT_ONCE
            some = F.slice(marks, first + 1, F.lit(_AT_ONCE))
            begin = end_of(first - 1)
            stop = end_of(F.least(first + _AT_ONCE, F.size(marks)) - 1)

            def fill(part: Column) -> Column:
                def one(mark: Column, i: Column) -> Column:
                    return F.concat(
                        _between(part, end_of(first + i - 1) - begin, mark["start"] - begin), mark["label"]
                    )

                return F.array_join(F.transform(some, one), "")

            return F.get(F.transform(F.array(_between(text, begin, stop)), fill), F.lit(0))

        blocks = F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / _AT_ONCE).cast("int"))
        rest = F.substring(text, (end_of(F.size(marks) - 1) + 1).cast("int"), F.length(text))
        full = F.concat(F.array_join(F.transform(blocks, block), ""), rest)
        return F.when(F.size(marks) > 0, full).otherwise(text)

    return F.get(F.transform(F.array(marks), whole), F.lit(0))


def _words(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, base, text``: spans by kind and start, and the text where there are any.

    Offsets count code points, the end is exclusive.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("fp"),
        F.concat(*[_found(kind, text) for kind in KINDS]).alias("base"),
        "text",
    )
    return materialize(rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "spans")


def protected_texts(spans: DataFrame) -> DataFrame:
    """``fp, copies, base, text, classes``: each distinct text with entities once.

    Entities of the same texts are one class, as any word tells the same of all of them; a class is
    the number of its documents and a 128-bit hash of its texts.
    """
    texts = spans.filter("size(base) > 0").groupBy("fp")
    texts = texts.agg(F.count(F.lit(1)).alias("copies"), F.first("base").alias("base"), F.first("text").alias("text"))
    texts = materialize(texts, "protected")
    entity = F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"])))
    pairs = texts.select("fp", "copies", F.explode(F.array_distinct(entity)).alias("entity"))
    known = pairs.groupBy("entity").agg(
        F.sum("copies").alias("n_entity"),
        F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("a"),
        F.bit_xor(F.xxhash64("fp", F.lit(2))).alias("b"),
    )
    classes = pairs.join(known, "entity").groupBy("fp")
    classes = classes.agg(F.collect_set(F.struct("n_entity", "a", "b")).alias("classes"))
    return materialize(texts.join(classes, "fp"), "classes")


def met(texts: DataFrame) -> DataFrame:
    """``fp, copies, n_entity, a, b, term``: the words of each text beside its classes."""
    beside = texts.select("fp", "copies", F.explode("classes").alias("c"), _words(F.col("text")).alias("words"))
    return beside.select("fp", "copies", "c.*", F.explode("words").alias("term"))


def disclosure(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``n_entity, a, b, term, strength``: how strongly a word tells of a class of entities, at most 1.

    ``strength = PMI / IC = log(N n_both / (n_term n_entity)) / log(N / n_entity)`` over documents;
    ``n_term`` counts every document of the corpus that has the word, ``n_both`` those of them that have the
    entity, anywhere. A pair that meets in a single document counts like any other; only entities
    of every document say nothing.
    """
    total = docs.count()
    both = met(texts).filter(F.col("n_entity") < total).groupBy("n_entity", "a", "b", "term")
    both = both.agg(F.sum("copies").alias("n_both"))
    terms = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term")
    terms = terms.agg(F.count(F.lit(1)).alias("n_term"))
    content = F.log2(total / F.col("n_entity"))
    shared = F.log2(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    return both.join(terms, "term").select("n_entity", "a", "b", "term", (shared / content).alias("strength"))


def term_spans(texts: DataFrame, strengths: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``fp, terms``: all occurrences of revealing words outside the spans as ``start, end, strength``."""
    strong = met(texts).join(strengths.filter(F.col("strength") >= generalise), ["n_entity", "a", "b", "term"])
    strong = strong.groupBy("fp", "term").agg(F.max("strength").alias("strength"))
    blank = F.transform(
        "base", lambda s: F.struct(s["start"], s["end"], F.lit("").alias("label"))
    ).cast(MARKS)
    blank = F.transform(
        _merged(blank), lambda s: F.struct(s["start"], s["end"], F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))
    ).cast(MARKS)
    free = texts.select("fp", _replaced(F.col("text"), blank).alias("text"))
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    pairs = F.arrays_zip(
        words.alias("word"), F.slice(F.split("text", TERM, -1), F.lit(1), F.size(words)).alias("left")
    )
    places = free.select("fp", F.posexplode(pairs).alias("place", "w"))
    end = F.sum(F.length("w.left") + F.length("w.word")).over(Window.partitionBy("fp").orderBy("place"))
    places = places.select(
        "fp", F.lower("w.word").alias("term"), (end - F.length("w.word")).alias("start"), end.alias("end")
    )
    hits = places.join(strong, ["fp", "term"]).groupBy("fp")
    return hits.agg(F.array_sort(F.collect_list(F.struct("start", "end", "strength"))).alias("terms"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, base, terms`` for every row of ``docs`` (``doc_id, text``).

    Null text counts as empty. Rows with null ids and rows that repeat an id are rows of their own
    (repeated rows have equal results). Other columns are ignored.
    """
    spans = base_spans(docs)
    texts = protected_texts(spans)
    terms = materialize(term_spans(texts, disclosure(docs, texts)), "terms")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,strength:double>>")
    held = spans.filter("size(base) > 0").join(terms, "fp", "left")
    rest = spans.filter("size(base) = 0").withColumn("terms", empty)
    names = "doc_id", "fp", "base", F.coalesce("terms", empty).alias("terms")
    return held.select(*names).unionByName(rest.select(*names))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced and ``n_chars`` brought up to date.

    A span becomes its kind in brackets, a generalised word ``[TERM]``, a removed word nothing.
    Spans that overlap are replaced together, under the name of the first. Null stays null.
    """
    found = find_personal_data(docs).filter("size(base) + size(terms) > 0").distinct()
    base = F.transform(
        "base",
        lambda s: F.struct(s["start"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
    ).cast(MARKS)
    terms = F.transform(
        "terms",
        lambda s: F.struct(
            s["start"], s["end"], F.when(s["strength"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]"))
        ),
    ).cast(MARKS)
    marks = found.select(
        F.col("doc_id").alias("_id"),
        F.col("fp").alias("_fp"),
        F.array_sort(F.concat(_merged(base), terms)).alias("_marks"),
    )
    # the row travels as one column, so that its names cannot clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row.text")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_fp"))
    rows = rows.join(marks, same, "left")
    new = F.when(F.col("_marks").isNull(), text).otherwise(_replaced(text, F.col("_marks")))
    rows = rows.withColumn("_new", new)
    made = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return rows.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def q_op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    terms = F.transform(
        "terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.concat_ws(
            ",",
            F.when(F.size("base") > 0, _joined(F.col("base"))),
            F.when(F.size("terms") > 0, _joined(terms)),
        ).alias("spans"),
    )
