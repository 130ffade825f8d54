"""Connected components by contraction, for any number of links."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def least_reached(like: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest id that it reaches, its own included."""
    least, before = ids.copy(), None
    while before is None or (before != least).any():
        before = least
        near = np.where(like, least, np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, near)
    return least


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``edges`` (``u long, v long``).

    ``component`` is the smallest node that can be reached. Each round points every node to
    the least of its neighbours and itself, by number and by a changing hash in turn (which
    makes the number of nodes shrink by a constant factor whatever the shape), and goes on with
    the links between what is left. Links that fall together are removed. Minima are combined
    before the shuffle, the joins have two written sides, so that a node with very many
    links is split, and each round is written to the shared folder.
    """
    edges = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.col("v") if len(steps) % 2 == 0 else F.xxhash64("v", F.lit(len(steps)))
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        around = both.union(both.select("u", F.col("u")))
        least = around.groupBy("u").agg(F.min(F.struct(order.alias("rank"), F.col("v"))).alias("best"))
        step = materialize(least.select(F.col("u").alias("node"), F.col("best.v").alias("to")), "step")
        steps.append(step)
        left = edges.join(step.toDF("u", "a"), "u").select("a", "v")
        moved = left.join(step.toDF("v", "b"), "v").filter("a <> b")
        edges = materialize(
            moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def follow(so_far: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.toDF("to", "further")
        return so_far.join(nxt, "to", "left").select("node", F.coalesce("further", "to").alias("to"))

    last = materialize(reduce(follow, steps), "roots")
    least = materialize(last.groupBy("to").agg(F.min("node").alias("component")), "least")
    return last.join(least, "to").select("node", "component")
