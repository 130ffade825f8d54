"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies. Its whole part is taken; the
fraction is rounded so that the words taken stay the same: two documents meet, and a random one
of two transfers of expected words makes one of them whole (0 or 1 copy). The chances are such that no
document's expectation changes. Documents meet in buckets of about ``FAN``; what each bucket
leaves open meets again one level up, in a tree over the buckets of a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FAN = 64
COPIES = 4096  # repeated rows that are numbered in one step
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame) -> DataFrame:
    """``source, source_size, n_docs, target``: words that the mix takes from each source.

    Sources in code point order, null last, weigh 5, 2, 1 and so on. All targets add up to
    ``SHARE`` times all words; one that would exceed ``MOST`` times its source stops there and the
    excess goes to the others by weight. In the order of size by weight, a source stops if the
    level that the rest would get, with all before it stopped, is not below its own.
    """
    sizes = units.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    all_rows = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn(
        "ratio", F.col("source_size") * MOST / F.col("weight")
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(all_rows) * SHARE
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST
    ) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.select(
        "*", level.alias("level"), F.row_number().over(by_ratio).alias("order")
    ).withColumn("stops", F.col("level") >= F.col("ratio"))
    first_free = F.min(F.when(~F.col("stops"), F.struct("order", "level"))).over(all_rows)
    return ranked.withColumn("free", first_free["level"]).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("stops"), F.col("source_size") * MOST)
        .otherwise(F.col("weight") * F.col("free"))
        .cast("double")
        .alias("target"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number ``no`` among their equals.

    Equal rows are counted before the shuffle and written out again by number, first in runs of
    ``COPIES`` that are dealt to all tasks, so any number of them is spread and numbers do not depend on
    where a row was read.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    runs = counted.select(*names, "n", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")).alias("run"))
    dealt = runs.repartition(F.xxhash64(*[F.col(c) for c in names], "run"))
    first = F.col("run") * COPIES
    return dealt.select(*names, F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)).alias("no"))


def _chance(a: Column, b: Column) -> Column:
    """A number in [0, 1) that depends on the two documents only, so that reruns agree."""
    bits = F.xxhash64(*[u[c] for u in (a, b) for c in ("doc_id", "fp", "no")], F.lit("pivot"))
    return F.pmod(bits, F.lit(1 << 52)) / float(1 << 52)


def _meet(state: Column, new: Column) -> Column:
    """One pivotal step: the open document of ``state`` against ``new``.

    ``mass`` is a document's expected words, between 0 and ``size``.
    """
    old = state["open"]
    give = F.least(old["mass"], new["size"] - new["mass"])  # from old to new
    take = F.least(new["mass"], old["size"] - old["mass"])  # from new to old
    gives = _chance(old, new) * (give + take) < take

    def at(unit: Column, mass: Column) -> Column:
        return unit.withField("mass", mass.cast("double"))

    none = F.lit(0.0)
    old_wins = old["mass"] <= new["size"] - new["mass"]
    new_wins = new["mass"] <= old["size"] - old["mass"]
    done = F.when(
        gives, F.when(old_wins, at(old, none)).otherwise(at(new, new["size"]))
    ).otherwise(F.when(new_wins, at(new, none)).otherwise(at(old, old["size"])))
    still = F.when(
        gives,
        F.when(old_wins, at(new, new["mass"] + old["mass"])).otherwise(at(old, old["mass"] - give)),
    ).otherwise(
        F.when(new_wins, at(old, old["mass"] + new["mass"])).otherwise(at(new, new["mass"] - take))
    )
    first = old.isNull()
    return F.struct(
        F.when(first, new).otherwise(still).alias("open"),
        F.when(first, state["done"]).otherwise(F.concat(state["done"], F.array(done))).alias("done"),
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, size, source_size, target, copies, taken`` for every row of ``docs``.

    Needs ``doc_id, source, text``; ``fp`` is a hash of the text. ``copies`` is 0, 1 or 2 and ``taken`` is
    ``copies * size``. The words taken from a source differ from its target by at most half of
    one document: the last open document of a source goes to the nearer side. Null and empty
    texts have size 0 and take nothing (copies: the whole part of the expected number). Null sources
    are one source, null ids and repeated rows are documents of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    units = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("fp"),
        "source",
        text_size(F.col("text")).alias("size"),
    )
    units = materialize(_numbered(units), "units")
    targets = materialize(source_targets(units), "targets")
    wanted = targets.withColumnRenamed("source", "_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        units.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("mass", (F.col("expected") - F.col("whole")) * F.col("size"))
    )
    fields = ["doc_id", "fp", "no", "size", "source_size", "target", "whole"]
    is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    settled = rows.filter(~is_open).withColumn("mass", F.lit(0.0)).select(*fields, "mass")
    buckets = F.ceil(F.col("n_docs") / FAN)
    level = rows.filter(is_open).select(
        "source",
        F.pmod(F.xxhash64("doc_id", "fp", "no"), buckets).alias("bucket"),
        F.struct(*fields, "mass").alias("unit"),
    )
    unit_type = level.schema["unit"].dataType.simpleString()
    width = targets.agg(F.max(F.ceil(F.col("n_docs") / FAN))).first()[0] or 0
    done = [settled]
    while width:
        folded = level.groupBy("source", "bucket").agg(
            F.aggregate(
                F.array_sort(F.collect_list("unit")),
                F.struct(
                    F.lit(None).cast(unit_type).alias("open"),
                    F.array().cast(f"array<{unit_type}>").alias("done"),
                ),
                _meet,
            ).alias("state")
        )
        folded = materialize(folded, "rounding")
        done.append(folded.select(F.explode("state.done").alias("unit")).select("unit.*"))
        level = folded.select(
            "source",
            F.expr(f"bucket div {FAN}").alias("bucket"),
            F.col("state.open").alias("unit"),
        )
        width = 0 if width == 1 else -(-width // FAN)
    if len(done) > 1:
        nearer = F.when(F.col("mass") * 2 >= F.col("size"), F.col("size").cast("double")).otherwise(0.0)
        done.append(level.select("unit.*").withColumn("mass", nearer))
    taken = reduce(DataFrame.unionByName, done)
    copies = F.col("whole") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    return taken.withColumn("copies", copies.cast("long")).select(
        "doc_id",
        "fp",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says."""
    names = ["_id", "_null", "_fp"]

    def keys(doc_id: Column, fp: Column) -> list[Column]:
        parts = F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), fp
        return [k.alias(n) for k, n in zip(parts, names)]

    # the row travels as one column, so that its names cannot clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(row, *keys(F.col("doc_id"), F.xxhash64("text")))
    right = mixed.select("copies", *keys(F.col("doc_id"), F.col("fp")))
    left = left.withColumn("_no", F.row_number().over(Window.partitionBy(*names).orderBy("_fp")))
    right = right.withColumn("_no", F.row_number().over(Window.partitionBy(*names).orderBy("copies")))
    both = left.join(right.filter("copies > 0"), [*names, "_no"])
    return both.select("_row", F.explode(F.expr("sequence(1, copies)")).alias("_copy")).select("_row.*")


def q_op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).drop("fp")
