"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors a cosine of at least t means a Euclidean distance of at most
``epsilon = sqrt(2 - 2 t)``. The vectors are turned to their principal axes and sorted by label and by the
grid cells of width epsilon on the leading axes. Intervals of this sequence form a tree; starting
with the whole sequence, pairs of intervals are split and split again, and a pair whose boxes lie
further than epsilon apart on the leading axes, or share no label, is dropped. What is left at the
leaves, pairs of small blocks, is compared by a matrix product.

Equal vectors are one class, represented by the smallest id. Links never become rows: a comparison
of two blocks returns a row per vector with its number of links and the smallest id it reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_row_index
from ..session import materialize
from .components import connected_components, least_reached
from .textbatch import map_batches

COSINE = 0.93
LEAF = 512  # vectors in a block
FAN = 8  # intervals that an interval is split into
AXES = 8  # leading axes in boxes; the first CELLS of them order the sequence
CELLS = 4


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec``: doubles of length one, as bytes; null if the vector links with nothing."""

    def normalise(batches):
        for batch in batches:
            out = []
            for vec_id, label, vec in zip(*batch.columns):
                unit = None
                if vec_id.is_valid and label.is_valid and vec.is_valid and not vec.values.null_count:
                    x = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                    if top > 0:
                        x = x / top
                        unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"]
            )

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return map_batches(rows, normalise, "vec_id long, label long, vec binary")


def _padded(vecs: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(vecs), size))
    for i, v in enumerate(vecs):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


def principal_axes(classes: DataFrame, size: int, axes: int = AXES) -> np.ndarray:
    """Leading eigenvectors of the covariance, as columns. Moments are summed in Spark; what
    reaches the driver depends on the vector size only."""

    def moments(batches):
        first, second, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            x = _padded(batch.column(0).to_pylist(), size)
            first, second, n = first + x.sum(0), second + x.T @ x, n + len(x)
        values = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"]
        )

    sums = map_batches(classes.select("vec"), moments, "place long, value double")
    rows = sums.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    values = rows.sort_values("place")["value"].to_numpy()
    n, first, second = values[0], values[1 : size + 1], values[size + 1 :].reshape(size, size)
    mean = first / max(n, 1)
    _, vectors = np.linalg.eigh(second / max(n, 1) - np.outer(mean, mean))
    return vectors[:, ::-1][:, :axes]


def _sequence(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """The classes in grid order: ``row_index`` and the coordinates ``at`` on the leading axes."""
    size = len(axes)

    def project(batches):
        for batch in batches:
            at = _padded(batch.column(3).to_pylist(), size) @ axes
            offsets = pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(at.ravel()))],
                [*batch.schema.names, "at"],
            )

    placed = map_batches(
        classes.select("label", "rep", "members", "vec"),
        project,
        "label long, rep long, members long, vec binary, at array<double>",
    )
    cells = [f"_cell{k}" for k in range(min(CELLS, axes.shape[1]))]
    for k, name in enumerate(cells):
        placed = placed.withColumn(name, F.floor(F.col("at")[k] / epsilon))
    return with_row_index(placed, "label", *cells, "rep").drop(*cells)


def _close_blocks(sequence: DataFrame, total: int, axes: int, epsilon: float) -> DataFrame:
    """``a, b``: pairs of blocks, ``a <= b``, that the recursion does not prove distant."""
    sides = []
    for k in range(axes):
        sides += [F.min(F.col("at")[k]).alias(f"lo{k}"), F.max(F.col("at")[k]).alias(f"hi{k}")]
    block = F.expr(f"row_index div {LEAF}").alias("node")
    boxes = sequence.groupBy(block).agg(
        F.min("label").alias("first"), F.max("label").alias("last"), *sides
    )
    levels = [materialize(boxes, "boxes")]
    nodes = -(-total // LEAF)
    while nodes > 1:
        up = [F.min(c) if c.startswith(("lo", "first")) else F.max(c) for c in levels[-1].columns[1:]]
        names = levels[-1].columns[1:]
        parent = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node"))
        levels.append(parent.agg(*[u.alias(n) for u, n in zip(up, names)]))
        nodes = -(-nodes // FAN)
    spark = sequence.sparkSession
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for boxes in reversed(levels[:-1]):
        pairs = pairs.select(F.explode(F.expr(f"sequence(a * {FAN}, a * {FAN} + {FAN - 1})")).alias("a"), "b")
        pairs = pairs.select("a", F.explode(F.expr(f"sequence(b * {FAN}, b * {FAN} + {FAN - 1})")).alias("b"))
        one = boxes.toDF("a", *[f"a_{c}" for c in boxes.columns[1:]])
        two = boxes.toDF("b", *[f"b_{c}" for c in boxes.columns[1:]])
        gaps = [f"greatest(0, a_lo{k} - b_hi{k}, b_lo{k} - a_hi{k})" for k in range(axes)]
        distance = " + ".join(f"{g} * {g}" for g in gaps)
        pairs = (
            pairs.filter("a <= b")
            .join(one, "a")
            .join(two, "b")
            .filter("a_first <= b_last AND b_first <= a_last")
            .filter(f"{distance} <= {epsilon**2 * (1 + 1e-9)}")
            .select("a", "b")
        )
    return materialize(pairs, "blockpairs")


def _compare(sequence: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``rep, root, links`` for each vector and pair of blocks in which it has links."""
    both = pairs.select("a", "b", F.col("a").alias("block"))
    both = both.union(pairs.filter("a <> b").select("a", "b", F.col("b")))
    rows = sequence.select(
        F.expr(f"row_index div {LEAF}").alias("block"), "label", "rep", "members", "vec"
    ).join(both, "block")

    def compare(table: pa.Table) -> pa.Table:
        a, b, block, label, rep, members = (table.column(i).to_numpy() for i in range(6))
        raw = table.column(6).to_pylist()
        size = np.array([len(v) for v in raw])
        x = _padded(raw, size.max() // 8)
        like = x @ x.T >= cosine
        like &= (label[:, None] == label) & (size[:, None] == size)
        np.fill_diagonal(like, False)
        if a[0] != b[0]:
            like &= block[:, None] != block
        root, links = least_reached(like, rep), like @ members
        some = links > 0
        return pa.table({"rep": rep[some], "root": root[some], "links": links[some]})

    rows = rows.select("a", "b", "block", "label", "rep", "members", "vec")
    return rows.groupBy("a", "b").applyInArrow(compare, "rep long, root long, links long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows`` (``vec_id, embedding, label``).

    Vectors link when their labels are equal and their cosine in double precision is at least ``cosine``.
    A null id or label, and a vector that is null, empty, zero or has null or non-finite
    components, links with nothing; so do vectors of different sizes. Every other row with an equal
    vector counts as a link, also under the same id. ``cosine`` must be positive. Other columns
    are ignored.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    units = materialize(unit_vectors(rows), "units")
    classes = materialize(
        units.filter("vec IS NOT NULL")
        .groupBy("label", "vec")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")),
        "classes",
    )
    total, size = classes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    if not total:
        return units.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    axes = principal_axes(classes, size // 8)
    sequence = materialize(_sequence(classes, axes, epsilon), "sequence")
    pairs = _close_blocks(sequence, total, axes.shape[1], epsilon)
    linked = materialize(_compare(sequence, pairs, cosine), "linked")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    groups = links.join(found.toDF("rep", "component"), "rep")
    classes = materialize(
        classes.join(groups, "rep", "left").select(
            "label",
            "vec",
            F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"),
        ),
        "groups",
    )
    return units.join(classes, ["label", "vec"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )


def q_op1_grid_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES = {
    "op1_grid_join": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
    AND len([e FOR e IN embedding IF e <> 0]) > 0
),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
  ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93
),
reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT id, min(other) AS low FROM reach GROUP BY id),
counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN counted ON counted.id = vec_id
"""
}
