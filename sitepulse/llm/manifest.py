"""Merkle manifest of a dataset: checkpoint and recompute.

Each group of rows (a language) is a tree over its rows' digests in key order, and the groups' roots
are the leaves of one more tree. A node is the digest of up to ``FAN`` consecutive nodes
below it, and a tree ends where one node remains.

Only every ``STEP``-th level is stored. Between two stored levels lie aligned subtrees of at most
``FAN ** STEP`` stored nodes; one task call handles one subtree. To extract proofs, each
subtree is grown again from its stored descendants, hands the siblings on every level to its
members, together with the path that its own top got from the stored level above, and is
forgotten. So neither the missing levels nor a whole tree is ever held, and a group
with most of the rows is as many small subtrees as any others of that size.

Defined results: a null counts as a value of its own in the digest of a row, null groups and null keys come first,
rows with equal keys are ordered by their digests (so equal rows are interchangeable), an empty
text differs from a null, and an empty table has a manifest without rows. Only the named columns are
read, whatever else the table has.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_row_index, write_sorted
from ..session import materialize, shared_dir

FAN = 8  # fixed by the format of the manifest
STEP = 3  # levels from one stored level to the next
DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
CONTEXT = f"subroot string, root string, path {PATH}"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path lead to."""
    step = lambda digest, level: F.sha2(F.concat(level["before"], digest, level["after"]), 256)
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    siblings = F.transform(path, lambda level: F.concat(level["before"], level["after"]))
    return F.sha2(F.array_join(siblings, ""), 256)


@dataclass
class Manifest:
    """Stored levels, lowest first: ``tree, pos, height, digest``; level 0 of ``leaves`` also has
    ``grp``, ``key`` and what else the leaves came with. ``groups`` is the tree of the groups' roots."""

    path: str
    leaves: list[DataFrame]
    groups: list[DataFrame]


def _height(n: Column) -> Column:
    return sum(((n > F.lit(FAN**i)).cast("int") for i in range(21)), F.lit(0))


def _last_stretch(height: Column) -> Column:
    """Number of the stored level that the top of a tree is grown from."""
    return F.greatest(F.ceil(height / STEP).cast("int") - 1, F.lit(0))


def _levels(digests: list[str], folds: int) -> list[list[str]]:
    levels = [digests]
    for _ in range(folds):
        below = levels[-1]
        runs = ("".join(below[i : i + FAN]) for i in range(0, len(below), FAN))
        levels.append([hashlib.sha256(run.encode()).hexdigest() for run in runs])
    return levels


def _folds(heights: pa.ChunkedArray, level: int) -> int:
    return min(STEP, heights[0].as_py() - level * STEP)


def _block(pos: str = "pos") -> Column:
    return F.shiftright(pos, 3 * STEP).alias("block")


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grow(bottom: DataFrame, path: str) -> list[DataFrame]:
    """Store every ``STEP``-th level above ``bottom`` too. One round per stored level."""
    stored = [_store(bottom, f"{path}/0")]
    highest = stored[0].agg(F.max("height")).first()[0] or 0

    def top_of(level):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("pos")
            digests = _levels(rows["digest"].to_pylist(), _folds(rows["height"], level))[-1]
            first = rows.slice(0, 1)
            return pa.table([first["tree"], first["block"], first["height"], pa.array(digests)], names)

        names = ["tree", "pos", "height", "digest"]
        return run

    while (level := len(stored) - 1) * STEP < highest:
        nodes = stored[-1].filter(F.col("height") > level * STEP).select("tree", _block(), "pos", "height", "digest")
        up = nodes.groupBy("tree", "block").applyInArrow(
            top_of(level), "tree long, pos long, height int, digest string"
        )
        stored.append(_store(up, f"{path}/{level + 1}"))
    return stored


def _tops(stored: list[DataFrame]) -> DataFrame:
    """``tree, height, digest`` of each tree's last node, which lies on its uppermost stored level."""
    found = [
        nodes.filter((F.ceil(F.col("height") / STEP) == level) & (F.col("pos") == 0)).select(
            "tree", "height", "digest"
        )
        for level, nodes in enumerate(stored)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _paths_of(level: int, names: list[str]):
    """For one subtree above a stored level: its members with the path from each to the root."""

    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").select(names)
        levels = _levels(rows["digest"].to_pylist(), _folds(rows["height"], level))[:-1]
        rest = top["path"][0].as_py()
        before, after, ends = [], [], [0]
        for place in range(len(rows)):
            for nodes in levels:
                first = place // FAN * FAN
                before.append("".join(nodes[first:place]))
                after.append("".join(nodes[place + 1 : first + FAN]))
                place //= FAN
            before += [step["before"] for step in rest]
            after += [step["after"] for step in rest]
            ends.append(len(before))
        steps = pa.StructArray.from_arrays(
            [pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]
        )
        for name in ("subroot", "root"):
            rows = rows.append_column(name, pa.array([top[name][0].as_py()] * len(rows), pa.string()))
        return rows.append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))

    return run


def _extract(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every node of the lowest level with ``subroot``, ``root`` and its ``path`` to the root.

    ``above`` has ``tree, height`` and those columns for the top of each tree.
    """
    inherited = None
    for level in reversed(range(len(stored))):
        nodes = stored[level].withColumn("block", _block())
        names = stored[level].columns
        begun = above.filter(_last_stretch(F.col("height")) == level)
        context = begun.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "path")
        if inherited is not None:
            context = context.union(inherited.select("tree", F.col("pos").alias("block"), "subroot", "root", "path"))
        if level:
            nodes = nodes.filter(F.col("height") > level * STEP)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored[level].schema.fields)
        inherited = (
            nodes.groupBy("tree", "block")
            .cogroup(context.groupBy("tree", "block"))
            .applyInArrow(_paths_of(level, names), f"{fields}, {CONTEXT}")
        )
    return inherited


def build_manifest(leaves: DataFrame, path: str | None = None) -> Manifest:
    """Write the manifest of ``leaves`` (``grp, key, digest`` and columns to keep) below ``path``.

    Places come from one range sort of digests, not of rows: the rank of a leaf in its
    group is the count of the group's leaves in earlier tasks plus its place in the own one.
    Without ``path`` a new folder in the shared one is used.
    """
    spark = leaves.sparkSession
    path = path or f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    placed = write_sorted(leaves, "grp", "key", "digest")
    spans = placed.groupBy("grp", "_task").agg(
        F.min("_place").alias("first"), F.count(F.lit(1)).alias("size")
    )
    spans = materialize(spans, "spans")  # a row per task and one per group beyond that
    own = Window.partitionBy("grp")
    earlier = F.sum("size").over(own.orderBy("_task")) - F.col("size")
    offsets = spans.select(
        F.col("grp").alias("_grp"),
        F.col("_task").alias("_in"),
        (earlier - F.col("first")).alias("_shift"),
        _height(F.sum("size").over(own)).alias("height"),
    )
    groups = with_row_index(spans.select("grp").distinct(), "grp").select(
        F.col("grp").alias("_named"), F.col("row_index").alias("tree"), F.col("row_total").alias("_trees")
    )
    offsets = offsets.join(groups, F.col("_grp").eqNullSafe(F.col("_named")))
    at = (F.col("_task") == F.col("_in")) & F.col("grp").eqNullSafe(F.col("_grp"))
    nodes = placed.join(offsets, at).select(
        "tree", (F.col("_place") + F.col("_shift")).alias("pos"), "height", *leaves.columns
    )
    stored = _grow(nodes, f"{path}/leaves")
    sizes = groups.select("tree", _height(F.col("_trees")).alias("height"))
    roots = _tops(stored).drop("height").join(sizes, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "height", "digest"
    )
    tops = _grow(roots, f"{path}/groups")
    shape = spark.createDataFrame([(len(stored), len(tops))], "leaves int, groups int")
    shape.coalesce(1).write.parquet(f"{path}/shape")  # written last: a manifest without it is not whole
    return Manifest(path, stored, tops)


def open_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest written before."""
    shape = spark.read.parquet(f"{path}/shape").first()
    leaves = [spark.read.parquet(f"{path}/leaves/{i}") for i in range(shape["leaves"])]
    groups = [spark.read.parquet(f"{path}/groups/{i}") for i in range(shape["groups"])]
    return Manifest(path, leaves, groups)


def group_roots(manifest: Manifest) -> DataFrame:
    """``tree, height, subroot, root, path`` of every group; ``path`` leads from subroot to root."""
    root = _tops(manifest.groups).select(
        "tree",
        "height",
        F.col("digest").alias("subroot"),
        F.col("digest").alias("root"),
        F.array().cast(PATH).alias("path"),
    )
    found = _extract(manifest.groups, root).select(
        F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "root", "path"
    )
    return found.join(_tops(manifest.leaves).select("tree", "height"), "tree")


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with ``digest``, ``subroot``, ``root`` and the ``path`` of siblings to the root."""
    return _extract(manifest.leaves, group_roots(manifest))


def q_op11_manifest(spark, sf_dir):
    """Manifest of all documents by language; a third of them is checked after a change of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [F.col(c) for c in DOCUMENT_FIELDS[:-1]]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        F.col("lang").alias("grp"),
        F.col("doc_id").alias("key"),
        leaf_digest(*kept, F.col("text")).alias("digest"),
        leaf_digest(*kept, F.when(tampered, lowered).otherwise(F.col("text"))).alias("presented"),
    )
    # written, because the range sort looks at its input twice
    found = proofs(build_manifest(materialize(leaves, "digests")))
    folded = fold(F.col("presented"), F.col("path"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_KEPT = " || ".join(_FIELD.format(c) for c in DOCUMENT_FIELDS[:-1])
_TEXT = _FIELD.format("text")
_LOWERED = _FIELD.format(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
_BIT = "CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END"
_BYTE = f"list_reduce(range(8), lambda d, i: {_BIT}, xor(c, b))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: {_BYTE}, CAST(4294967295 AS BIGINT)), 4294967295)"
_SIBLINGS = """
    SELECT tree, level, pos,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
    FROM {} WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)"""
_UP = """
    SELECT tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
    FROM {} WHERE n > 1 GROUP BY tree, level, pos // 8"""
_WALK = """
    SELECT w.id, w.level + 1, w.pos // 8, sha256(s.b || w.h || s.a), w.proof || s.b || s.a, w.tree
    FROM {0} w JOIN {1} s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos"""

ORACLES = {
    "op11_manifest": f"""
WITH RECURSIVE digests AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, lang, sha256({_KEPT} || {_TEXT}) AS leaf,
    sha256({_KEPT} || CASE WHEN {_CRC} % 3 = 0 THEN {_LOWERED} ELSE {_TEXT} END) AS presented
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM digests),
nodes(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed UNION ALL {_UP.format("nodes")}),
groups(tree, level, pos, n, h) AS (
  SELECT -1, 0, tree, (SELECT count(DISTINCT tree) FROM placed), h FROM nodes WHERE n = 1
  UNION ALL {_UP.format("groups")}),
near AS MATERIALIZED ({_SIBLINGS.format("nodes")}),
far AS MATERIALIZED ({_SIBLINGS.format("groups")}),
walk(id, level, pos, h, proof, tree) AS (
  SELECT id, 0, pos, presented, '', tree FROM placed UNION ALL {_WALK.format("walk", "near")}),
climb(id, level, pos, h, proof, tree) AS (
  SELECT w.id, 0, w.tree, w.h, w.proof, -1 FROM walk w JOIN nodes t ON t.tree = w.tree AND t.level = w.level AND t.n = 1
  UNION ALL {_WALK.format("climb", "far")})
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256,
  c.h AS folded_root, c.h = r.h AS verified
FROM placed p JOIN nodes t ON t.tree = p.tree AND t.n = 1
JOIN groups r ON r.n = 1 JOIN climb c ON c.id = p.id AND c.level = r.level
"""
}
