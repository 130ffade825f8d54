"""Gradient-boosted regression trees over binned features, for many fits in shared jobs.

All fits (grid points, folds) read one table of binned rows, and a fit is a range of its ``place`` column
to learn from and one to test on. Trees grow level by level: rows add their residuals to one bin per feature of their
node, the sums of bins give the best split of each node, and both halves go on. Squared loss, with the usual
``l2`` in leaf values and gains.

There are two ways to run the same steps. Up to ``TASK_ROWS`` rows a fit is a group: one job
has a group per fit, which goes through all its rounds in one task of bounded size. Beyond that the rows stay where
they are, all fits take each level in one job, grouped by (fit, node) with sums combined in every
task, and only the chosen splits reach the driver. So the number of jobs never depends on the
number of fits. The error on the test range is kept for every round, so growth stops by
itself when ``patience`` rounds brought nothing, and no fit is repeated.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Send this module by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64  # at most 256: a bin is one byte
TASK_ROWS = 1 << 18  # rows of a fit that one task may hold: 25 features take some 30 MB
BLOCK_ROWS = 1 << 14  # rows that are looked at together when they stay where they are
ROUNDS_TO_CUT = 4  # rounds after which the state of all rows is written: plans of cached plans grow fast
LEAST_GAIN = 1e-10
SKETCH = 10_000  # accuracy of the quantiles that bound the bins
ROWS = "place long, label double, bins binary"
ROUND = (
    "fit int, round int, mae double, mse double, base double, feature array<int>, bin array<int>, "
    "value array<double>, gain array<double>"
)


@dataclass(frozen=True)
class Fit:
    """One model: parameters and the half-open ranges of ``place`` to learn from and to test on."""

    depth: int
    rate: float
    rounds: int
    train: tuple[int, int]
    held: tuple[int, int] = (0, 0)
    patience: int | None = None
    l2: float = 1.0
    trees: bool = False  # whether the trees are wanted, not only the errors


@dataclass
class Tree:
    """A heap: node i has children 2i+1 (bin at most ``bin``) and 2i+2; ``feature`` is -1 in a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def leaves(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after ``levels`` steps; ``bins`` has a line per feature."""
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(levels):
            feature = self.feature[node]
            right = bins[feature, rows] > self.bin[node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Grown:
    """What a fit came to: the trees up to the best round and the errors after each round."""

    base: float
    trees: list[Tree]
    mae: list[float]
    mse: list[float]


def bin_edges(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Upper bounds of all bins but the last one, per column, from quantiles in one pass."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, SKETCH) for c in names]).first()
    return [np.unique(np.array(edges or [], np.float64)) for edges in found]


def bin_rows(rows: DataFrame, names: list[str], edges: list[np.ndarray], place, label: str) -> DataFrame:
    """``place, label`` and a byte per feature: how many bounds are smaller than the value."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns[2:]]
            bins = np.empty((len(batch), len(edges)), np.uint8)
            for i, (value, bound) in enumerate(zip(values, edges)):
                bins[:, i] = np.searchsorted(bound, value)
            at = pa.array(np.arange(len(batch) + 1) * len(edges), pa.int32())
            blob = pa.Array.from_buffers(
                pa.binary(), len(batch), [None, at.buffers()[1], pa.py_buffer(bins.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], blob], ["place", "label", "bins"])

    narrow = rows.select(
        place.cast("long").alias("place"), F.col(label).cast("double").alias("label"), *names
    )
    return narrow.mapInArrow(cut, ROWS)


def _matrix(blobs: pa.Array, features: int) -> np.ndarray:
    """A line per feature."""
    data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8)
    return np.ascontiguousarray(data.reshape(-1, features).T)


def node_sums(bins: np.ndarray, node: np.ndarray, rest: np.ndarray, nodes: int) -> np.ndarray:
    """Sum of ``rest`` and number of rows: [2, node, feature, bin]."""
    out = np.empty((2, nodes, len(bins), BINS))
    at = node * BINS
    for i, line in enumerate(bins):
        cell = at + line
        out[0, :, i] = np.bincount(cell, rest, nodes * BINS).reshape(nodes, BINS)
        out[1, :, i] = np.bincount(cell, minlength=nodes * BINS).reshape(nodes, BINS)
    return out


def best_splits(sums: np.ndarray, l2: float) -> tuple[np.ndarray, ...]:
    """Per node: feature (-1: none), bin, gain, and sum and rows of the left half and of the node."""
    total = sums[:, :, 0].sum(axis=-1)
    left = np.cumsum(sums, axis=-1)[..., :-1]
    right = total[:, :, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)
        gain -= (total[0] ** 2 / (total[1] + l2))[:, None, None]
    gain[(left[1] == 0) | (right[1] == 0)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    gain = flat[np.arange(len(flat)), best]
    feature, bin_ = np.divmod(best, BINS - 1)
    feature = np.where(gain > LEAST_GAIN, feature, -1)
    half = left.reshape(2, len(flat), -1)[:, np.arange(len(flat)), best]
    return feature, bin_, gain, half, total


def _extend(tree: Tree, nodes: np.ndarray, splits: tuple[np.ndarray, ...], fit: Fit) -> None:
    """Put the splits of ``nodes`` into the tree, and the values of their halves."""
    feature, bin_, gain, half, total = splits
    if nodes[0] == 0:
        tree.value[0] = fit.rate * total[0][0] / (total[1][0] + fit.l2) if total[1][0] else 0.0
    does = feature >= 0
    at = nodes[does]
    tree.feature[at], tree.bin[at], tree.gain[at] = feature[does], bin_[does], gain[does]
    rest = total - half
    for child, part in ((2 * at + 1, half[:, does]), (2 * at + 2, rest[:, does])):
        tree.value[child] = fit.rate * part[0] / (part[1] + fit.l2)


def _stops(mse: list[float], fit: Fit) -> bool:
    return bool(fit.patience and mse) and len(mse) - 1 - int(np.argmin(mse)) >= fit.patience


def _kept(trees: list[Tree], mse: list[float], fit: Fit) -> list[Tree]:
    """The trees up to the best round, if rounds were judged."""
    return trees[: int(np.argmin(mse)) + 1] if fit.patience and mse else trees


def _grow(bins: np.ndarray, label: np.ndarray, train: np.ndarray, held: np.ndarray, fit: Fit) -> Grown:
    """All rounds of a fit over rows that are at hand."""
    base = float(label[train].mean()) if train.any() else 0.0
    score = np.full(len(label), base)
    learn = np.ascontiguousarray(bins[:, train])
    out = Grown(base, [], [], [])
    for _ in range(fit.rounds):
        tree, rest = Tree.empty(fit.depth), label[train] - score[train]
        node = np.zeros(len(rest), np.int64)
        for level in range(fit.depth):
            first = 2**level - 1
            here = node >= first
            nodes, at = np.unique(node[here], return_inverse=True)
            if not len(nodes):
                break
            sums = node_sums(learn[:, here], at, rest[here], len(nodes))
            _extend(tree, nodes, best_splits(sums, fit.l2), fit)
            node = tree.leaves(learn, level + 1)
        score += tree.value[tree.leaves(bins, fit.depth)]
        gap = label[held] - score[held]
        out.trees.append(tree)
        out.mae.append(float(np.abs(gap).mean()) if len(gap) else float("nan"))
        out.mse.append(float((gap**2).mean()) if len(gap) else float("nan"))
        if _stops(out.mse, fit):
            break
    out.trees = _kept(out.trees, out.mse, fit)
    return out


def _in(place, bounds: tuple[int, int]):
    return (place >= bounds[0]) & (place < bounds[1])


def _boost_groups(rows: DataFrame, fits: list[Fit], features: int) -> list[Grown]:
    """One job with a task-sized group per fit."""

    def run(table: pa.Table) -> pa.Table:
        number = table["fit"][0].as_py()
        fit = fits[number]
        place, label = np.asarray(table["place"]), np.asarray(table["label"])
        data = _matrix(table["bins"].combine_chunks(), features)
        order = np.lexsort((*data, label, place))  # sums must not depend on the order of arrival
        place, label, data = place[order], label[order], np.ascontiguousarray(data[:, order])
        grown = _grow(data, label, _in(place, fit.train), _in(place, fit.held), fit)
        out = []
        for i, (mae, mse) in enumerate(zip(grown.mae, grown.mse)):
            tree = grown.trees[i] if fit.trees and i < len(grown.trees) else None
            parts = [getattr(tree, c).tolist() if tree else [] for c in ("feature", "bin", "value", "gain")]
            out.append((number, i, mae, mse, grown.base, *parts))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema(
        [("fit", pa.int32()), ("round", pa.int32()), ("mae", pa.float64()), ("mse", pa.float64())]
        + [("base", pa.float64()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32()))]
        + [("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))]
    )
    ranges = F.array(
        *[
            F.when(_in(F.col("place"), f.train) | _in(F.col("place"), f.held), F.lit(i))
            for i, f in enumerate(fits)
        ]
    )
    sent = rows.select(F.explode(F.array_compact(ranges)).alias("fit"), "*")
    found = sent.repartition(len(fits), "fit").groupBy("fit").applyInArrow(run, ROUND)
    grown = [Grown(0.0, [], [], []) for _ in fits]
    for r in sorted(found.collect(), key=lambda r: (r["fit"], r["round"])):  # as many rows as rounds
        out = grown[r["fit"]]
        out.base = r["base"]
        out.mae.append(r["mae"])
        out.mse.append(r["mse"])
        if r["feature"]:
            out.trees.append(Tree(*(np.array(r[c]) for c in ("feature", "bin", "value", "gain"))))
    return grown


_STATE = "place binary, label binary, bins binary, score binary"


def _blocks(rows: DataFrame, bases: list[float], features: int) -> DataFrame:
    """Rows as blocks of at most ``BLOCK_ROWS``, with a score for every fit."""

    def pack(batches):
        for batch in batches:
            for begin in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                score = np.repeat(np.array(bases)[:, None], len(part), axis=1)
                columns = [np.asarray(part["place"]), np.asarray(part["label"]), _matrix(part["bins"], features), score]
                arrays = [pa.array([c.tobytes()], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "label", "bins", "score"])

    return rows.mapInArrow(pack, _STATE)


def _unblock(row: dict, features: int, fits: int) -> tuple[np.ndarray, ...]:
    return (
        np.frombuffer(row["place"], np.int64),
        np.frombuffer(row["label"]),
        np.frombuffer(row["bins"], np.uint8).reshape(features, -1),
        np.frombuffer(row["score"]).reshape(fits, -1),
    )


def _level_sums(state: DataFrame, fits: list[Fit], trees: dict[int, Tree], level: int, features: int):
    """The best split of every node of a level, for all fits that still grow: one job.

    A task adds up its rows by (fit, node); groups add up tasks. On level 0 the errors of the rounds
    before come along as node -1.
    """

    def add(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                place, label, bins, score = _unblock(row, features, len(fits))
                for i, tree in trees.items():
                    rest = label - score[i]
                    if level == 0:
                        gap = rest[_in(place, fits[i].held)]
                        error = np.array([np.abs(gap).sum(), (gap**2).sum(), len(gap)])
                        totals[i, -1] = totals.get((i, -1), 0) + error
                    learn = _in(place, fits[i].train)
                    mine = np.ascontiguousarray(bins[:, learn])
                    node = tree.leaves(mine, level)
                    here = node >= 2**level - 1
                    nodes, at = np.unique(node[here], return_inverse=True)
                    if len(nodes):
                        sums = node_sums(mine[:, here], at, rest[learn][here], len(nodes))
                        for n, part in zip(nodes.tolist(), np.moveaxis(sums, 1, 0)):
                            totals[i, n] = totals.get((i, n), 0) + part
        keys = list(totals)
        arrays = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64())]
        blobs = pa.array([np.ascontiguousarray(totals[k]).tobytes() for k in keys], pa.binary())
        yield pa.RecordBatch.from_arrays([*arrays, blobs], ["fit", "node", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table["sums"].to_pylist())
        fit, node = table["fit"][0].as_py(), table["node"][0].as_py()
        if node >= 0:
            feature, bin_, gain, half, whole = best_splits(total.reshape(2, 1, features, BINS), fits[fit].l2)
            total = np.concatenate([feature, bin_, gain, half.ravel(), whole.ravel()])
        return pa.table([[fit], [node], [total.tolist()]], schema=chosen)

    chosen = pa.schema([("fit", pa.int32()), ("node", pa.int64()), ("split", pa.list_(pa.float64()))])
    sums = state.mapInArrow(add, "fit int, node long, sums binary").groupBy("fit", "node")
    return sums.applyInArrow(choose, "fit int, node long, split array<double>").collect()


def _boost_levels(rows: DataFrame, fits: list[Fit], features: int) -> list[Grown]:
    """One job per level, for rows of any number."""
    means = rows.agg(
        *[F.avg(F.when(_in(F.col("place"), f.train), F.col("label"))) for f in fits]
    ).first()
    grown = [Grown(base or 0.0, [], [], []) for base in means]
    state = _blocks(rows, [g.base for g in grown], features).persist(StorageLevel.MEMORY_AND_DISK)
    growing = set(range(len(fits)))
    done = 0
    while growing:
        trees = {i: Tree.empty(fits[i].depth) for i in growing}
        level, active = 0, dict(trees)
        while active:
            by_fit: dict[int, list] = {}
            for row in _level_sums(state, fits, active, level, features):
                if row["node"] >= 0:
                    by_fit.setdefault(row["fit"], []).append((row["node"], row["split"]))
                elif done:
                    absolute, square, n = row["split"]
                    grown[row["fit"]].mae.append(absolute / n if n else float("nan"))
                    grown[row["fit"]].mse.append(square / n if n else float("nan"))
            if level == 0:
                for i in list(growing):
                    if done == fits[i].rounds or _stops(grown[i].mse, fits[i]):
                        growing.discard(i)
                        active.pop(i), trees.pop(i)
                        grown[i].trees = _kept(grown[i].trees, grown[i].mse, fits[i])
            for i in list(active):
                found = sorted(by_fit.get(i, []))
                if found:
                    nodes, table = np.array([n for n, _ in found]), np.array([s for _, s in found]).T
                    splits = table[0].astype(int), table[1].astype(int), table[2], table[3:5], table[5:7]
                    _extend(trees[i], nodes, splits, fits[i])
                if not found or level + 1 == fits[i].depth:
                    del active[i]
            level += 1
        if not growing:
            break
        for i, tree in trees.items():
            grown[i].trees.append(tree)

        def move(batches, trees=trees):
            for batch in batches:
                for row in batch.to_pylist():
                    _, _, bins, score = _unblock(row, features, len(fits))
                    score = score.copy()
                    for i, tree in trees.items():
                        score[i] += tree.value[tree.leaves(bins, fits[i].depth)]
                    row["score"] = score.tobytes()
                    yield pa.RecordBatch.from_pylist([row], batch.schema)

        before = state
        state = before.mapInArrow(move, _STATE)
        done += 1
        state = materialize(state, "scores") if done % ROUNDS_TO_CUT == 0 else state
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        before.unpersist()
    state.unpersist()
    return grown


def boost(rows: DataFrame, fits: Iterable[Fit], features: int) -> list[Grown]:
    """Grow all ``fits`` over ``rows`` (``place, label, bins``)."""
    fits = list(fits)
    place = F.col("place")
    counts = [F.count_if(_in(place, bounds)) for f in fits for bounds in (f.train, f.held)]
    sizes = rows.agg(*counts).first()
    held = sizes[1::2]
    fits = [f if n else replace(f, patience=None) for f, n in zip(fits, held)]
    at_most = max(a + b for a, b in zip(sizes[::2], held))
    return (_boost_groups if at_most <= TASK_ROWS else _boost_levels)(rows, fits, features)
