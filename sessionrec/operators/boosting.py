"""Boosted trees by histograms, the models of all folds side by side.

Rows are blocks (``operators.blocks``) with features in bins of one byte. A level of a tree is
one pass over the blocks for all models: a task adds gradients up in histograms of (tree
node, feature, bin), and histograms are summed and searched by chunks of features. Their size
depends on features, bins and nodes, not on rows. Sums are integers of fixed precision, so the
trees do not depend on partitioning, retried tasks or arrival order. Every ``KEEP`` trees the
margins are written with the blocks to the shared folder, from which a lost executor goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.operators.blocks import BLOCKS, block_reader, feature_array, feature_matrix
from sessionrec.sources.stages import materialize

BINS = 32
KEEP = 8
SCALE = 1 << 24  # fixed precision of gradient sums
ACCURACY = 1000  # of the quantiles that cut the bins
CHUNK = 32  # features whose histograms are summed and searched together

SUMS = "model int, chunk int, sums binary"
SPLITS = "model int, node int, feature int, bin int, gain double, g long, h long, n long, g_all long, h_all long, n_all long"


@dataclass
class Tree:
    """A complete binary tree: inner nodes in level order, then leaf values."""

    features: list[int]
    bins: list[int]  # rows with a bin up to this go left; -1 sends all right
    leaves: list[float]


@dataclass
class Objective:
    """What is boosted.

    ``gradients`` takes margins, labels, session numbers and the tree's number, and returns the
    rows that count, their gradients and hessians; ``metric`` a sum of scores (higher is better)
    and their weight.
    """

    gradients: Callable
    metric: Callable
    rate: Callable  # step by the number of the tree
    reg: float = 1.0
    least: int = 20
    scale: int = SCALE
    rows: float = 1.0  # share of rows and of features a tree is grown on
    features: float = 1.0
    seed: int = 77
    fewest: int = 0  # trees that are kept whatever the metric


@dataclass
class Grown:
    """A model while it grows. ``nodes`` are per tree (level, node) to split and sums."""

    fold: int
    trees: list[Tree] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    pending: list[Tree] = field(default_factory=list)
    done: bool = False


def _summary():
    """A function that merges sorted values with weights, in about ``size`` points of equal weight if there are more."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        weights = np.bincount(place, np.concatenate([w for _, w in parts]), len(values))
        if len(values) <= size:
            return values, weights
        reached = weights.cumsum()
        last = np.unique(np.searchsorted(reached, np.arange(1, size + 1) * (reached[-1] / size)).clip(max=len(values) - 1))
        return values[last], np.diff(reached[last], prepend=0.0)

    return merged


def bin_cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts of each feature: distinct quantiles of its known values.

    A task keeps the distinct values of a feature with their numbers, at most a few times
    ``ACCURACY`` points; the summaries of all tasks are merged feature by feature.
    """
    width, accuracy, merged = len(features), ACCURACY, _summary()
    matrix_of = feature_matrix(width)
    at = np.arange(1, bins) / bins

    def summed(batches):
        held: list[list] = [[] for _ in range(width)]
        for batch in batches:
            for parts, values in zip(held, matrix_of(batch["features"]).T.copy()):
                found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
                if len(found):
                    parts.append((found, counts.astype(np.float64)))
                if sum(len(v) for v, _ in parts) > 8 * accuracy:
                    parts[:] = [merged(parts, accuracy)]
        done = [(i, *merged(parts, accuracy)) for i, parts in enumerate(held) if parts]
        arrays = [pa.array([d[0] for d in done], pa.int32()), *[pa.array([d[k].tobytes() for d in done], pa.binary()) for k in (1, 2)]]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "points", "weights"])

    def cut(table: pa.Table) -> pa.Table:
        columns = ([np.frombuffer(x.as_buffer(), np.float64) for x in table[c]] for c in ("points", "weights"))
        values, weights = merged(list(zip(*columns)), 1 << 62)
        reached = weights.cumsum()
        chosen = values[np.searchsorted(reached, at * reached[-1]).clip(max=len(values) - 1)]
        return pa.table({"feature": table["feature"][:1], "cuts": pa.array([np.unique(chosen).tolist()], pa.list_(pa.float64()))})

    read = rows.select(feature_array(features).alias("features"))
    points = read.mapInArrow(summed, "feature int, points binary, weights binary")
    found = points.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect()
    by_feature = {r.feature: list(r.cuts) for r in found}
    return [by_feature.get(i, []) for i in range(width)]


def leaf_numbers():
    """Functions over binned rows: the node of each row in a partly grown tree, and a tree's values."""

    def nodes(bins: np.ndarray, rows: np.ndarray, features: list[int], splits: list[int], depth: int) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            feature = np.array(features[first : 2 * first + 1])[at]
            split = np.array(splits[first : 2 * first + 1])[at]
            at = 2 * at + (bins[feature, rows] > split)
        return at

    def values(bins: np.ndarray, trees: list) -> np.ndarray:
        total, rows = np.zeros(bins.shape[1]), np.arange(bins.shape[1])
        for features, splits, leaves in trees:
            total += np.array(leaves)[nodes(bins, rows, features, splits, len(leaves).bit_length() - 1)]
        return total

    return nodes, values


def plain(trees: list[Tree]) -> list[tuple]:
    return [(t.features, t.bins, t.leaves) for t in trees]


def histograms(blocks: DataFrame, width: int, cells: int, models: list[tuple], level: int, number: int, objective: Objective) -> DataFrame:
    """Sums of gradients, hessians and rows (``SUMS``) of every model, by task.

    A model is its number, its held-out fold, the trees not yet in its margins, features and bins of
    the tree that grows and the features it may use. Chunk -1 is the held-out rows' metric.
    """
    read, (nodes, values) = block_reader(width, np.uint8), leaf_numbers()
    gradients, metric, scale = objective.gradients, objective.metric, objective.scale
    share, seed, chunk, wide = objective.rows, objective.seed, CHUNK, 1 << level

    def drawn(ids: np.ndarray) -> np.ndarray:
        """A repeatable share of the rows, by a hash of their ids and the tree."""
        mixed = (ids[0] * 0x1F123BB5 + ids[1]).view(np.uint64) ^ np.uint64((seed + number) * 0x9E3779B97F4A7C15 % 2**64)
        for shift in (30, 27):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(40)) < np.uint64(int(share * (1 << 24)))

    def run(batches):
        sums = {m: np.zeros((3, len(columns), wide * cells), np.int64) for m, *_, columns in models}
        judged = {m: np.zeros(2, np.int64) for m, *_ in models}
        for ids, folds, labels, margins, bins, group in read(batches):
            kept = drawn(ids) if share < 1 else None
            for m, fold, pending, features, splits, columns in models:
                margin, held = margins[m] + values(bins, pending), folds == fold
                if not level and held.any():
                    score, weight = metric(margin[held], labels[held], group[held])
                    judged[m] += [round(score * scale), weight]
                train = np.flatnonzero(~held if kept is None else kept & ~held)
                counted, gradient, hessian = gradients(margin[train], labels[train], group[train], number)
                rows = train[counted]
                base = nodes(bins, rows, features, splits, level) * cells
                g, h = np.round(gradient * scale), np.round(hessian * scale)
                for k, column in enumerate(columns):
                    cell = base + bins[column][rows]
                    for total, amount in zip(sums[m], (g, h, None)):
                        total[k] += np.bincount(cell, amount, wide * cells).astype(np.int64)
        for m, total in sums.items():
            packed = [total[:, i : i + chunk].tobytes() for i in range(0, total.shape[1], chunk)]
            numbers = [-1, *range(len(packed))]
            arrays = [pa.array([m] * len(numbers), pa.int32()), pa.array(numbers, pa.int32()), pa.array([judged[m].tobytes(), *packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["model", "chunk", "sums"])

    return blocks.mapInArrow(run, SUMS)


def searched(sums: DataFrame, cells: int, level: int, columns: dict[int, list[int]], objective: Objective, every: bool = False) -> DataFrame:
    """The best cut of each node in each chunk (``SPLITS``), or with ``every`` all cuts that are allowed.

    A node without one has feature -1. Node -1 is the metric: g is its sum, n its weight.
    """
    chunk, wide, unit = CHUNK, 1 << level, 1.0 / objective.scale
    reg, least, names = objective.reg, objective.least, [c.split()[0] for c in SPLITS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        model, part = table["model"][0].as_py(), table["chunk"][0].as_py()
        total = sum(np.frombuffer(s.as_buffer(), np.int64) for s in table["sums"])
        if part < 0:
            found = [(model, -1, -1, 0, 0.0, int(total[0]), 0, int(total[1]), 0, 0, 0)]
        else:
            own = columns[model][part * chunk : (part + 1) * chunk]
            # (g, h, n), node, feature, bin
            total = total.reshape(3, len(own), wide, cells).transpose(0, 2, 1, 3)
            left, whole = total.cumsum(axis=3), total.sum(axis=3, keepdims=True)
            g, h, g_all, h_all = (x * unit for x in (left[0], left[1], whole[0], whole[1]))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = g * g / (h + reg) + (g_all - g) ** 2 / (h_all - h + reg) - g_all * g_all / (h_all + reg)
            fits = (left[2] >= max(least, 1)) & (whole[2] - left[2] >= max(least, 1)) & (total[2] > 0)
            gain = np.where(fits, gain, -np.inf)
            if every:
                places = np.argwhere(fits)
            else:
                flat = gain.reshape(wide, -1)
                best = np.argmax(flat, axis=1)  # of equal cuts the first feature's first
                places = [(node, *divmod(int(k), cells)) for node, k in enumerate(best) if whole[2, node, 0, 0]]
            found = []
            for node, f, b in places:
                good = every or gain[node, f, b] > 0
                sums_of = [int(x[node, f, b]) for x in left] + [int(x[node, f, 0]) for x in whole]
                found.append((model, int(node), own[f] if good else -1, int(b), float(gain[node, f, b]) if good else 0.0, *sums_of))
        kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.int64()] * 6
        values = zip(*found) if found else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds)], names)

    return sums.groupBy("model", "chunk").applyInArrow(run, SPLITS)


def _chosen_features(width: int, objective: Objective, model: int, number: int) -> list[int]:
    if objective.features >= 1:
        return list(range(width))
    draw = np.random.Generator(np.random.PCG64([objective.seed, model, number]))
    return sorted(draw.permutation(width)[: max(1, round(objective.features * width))].tolist())


def boost(
    blocks: DataFrame,
    cuts: list[list[float]],
    folds: list[int],
    objective: Objective,
    trees: int,
    depth: int,
    validate: bool,
    patience: int,
) -> list[Grown]:
    """One model per fold of ``folds``, grown on the rows of the other folds.

    Boosting ends with ``trees``, or with ``validate`` once the metric of the model's own fold has
    not risen for ``patience`` trees; then the trees up to its best are kept.
    """
    width, cells = len(cuts), max(map(len, cuts), default=0) + 1
    models = [Grown(fold) for fold in folds]
    rows = materialize(blocks, "blocks")
    for number in range(trees + 1):
        columns = {m: _chosen_features(width, objective, m, number) for m in range(len(models))}
        splits: list[dict[int, tuple[int, int]]] = [{} for _ in models]
        leaves = [[0.0] * (1 << depth) for _ in models]
        seen: list[dict] = [{} for _ in models]
        rate = objective.rate(number)
        for level in range(depth):
            going = [m for m, model in enumerate(models) if not model.done]
            if not going or number == trees and not (validate and level == 0):
                break
            at = {m: [splits[m].get(i, (0, -1)) for i in range((1 << level) - 1)] for m in going}
            tasks = [(m, models[m].fold, plain(models[m].pending), [f for f, _ in at[m]], [b for _, b in at[m]], columns[m]) for m in going]
            sums = histograms(rows, width, cells, tasks, level, number, objective)
            found = searched(sums, cells, level, columns, objective).collect()
            if level == 0 and validate:
                held = {r.model: r for r in found if r.node < 0}
                for m in going:
                    r = held.get(m)
                    models[m].scores.append(r.g / objective.scale / r.n if r and r.n else 0.0)
                    best = _best(models[m].scores, objective.fewest)
                    models[m].done = number == trees or number - best >= patience
            best_cuts: dict[tuple[int, int], object] = {}
            for r in found:
                if r.node >= 0:
                    old = best_cuts.get((r.model, r.node))
                    if old is None or (-r.gain, r.feature < 0, r.feature) < (-old.gain, old.feature < 0, old.feature):
                        best_cuts[r.model, r.node] = r
            unit = 1.0 / objective.scale
            for (m, node), r in best_cuts.items():
                # A node that is not split keeps its step on both sides, down to the leaves.
                step = -rate * (r.g_all * unit) / (r.h_all * unit + objective.reg)
                span = 1 << (depth - level)
                leaves[m][node * span : (node + 1) * span] = [step] * span
                seen[m][level, node] = (r.feature, r.bin, r.gain, r.g_all * unit, r.h_all * unit, r.n_all)
                if r.feature < 0:
                    continue
                splits[m][(1 << level) - 1 + node] = (r.feature, r.bin)
                span = 1 << (depth - level - 1)
                for side, (g, h, n) in enumerate(((r.g, r.h, r.n), (r.g_all - r.g, r.h_all - r.h, r.n_all - r.n))):
                    start = (2 * node + side) * span
                    leaves[m][start : start + span] = [-rate * (g * unit) / (h * unit + objective.reg)] * span
                    seen[m][level + 1, 2 * node + side] = (-1, 0, 0.0, g * unit, h * unit, n)
        going = [m for m, model in enumerate(models) if not model.done]
        if number == trees or not going:
            break
        for m in going:
            inner = [splits[m].get(i, (0, -1)) for i in range((1 << depth) - 1)]
            tree = Tree([f for f, _ in inner], [b for _, b in inner], leaves[m])
            models[m].trees.append(tree)
            models[m].nodes.append(seen[m])
            models[m].pending.append(tree)
        if len(models[going[0]].pending) == KEEP:
            rows = materialize(_advanced(rows, width, {m: plain(models[m].pending) for m in going}), "blocks")
            for model in models:
                model.pending = []
    if validate:
        for model in models:
            kept = _best(model.scores, objective.fewest) if model.scores else 0
            model.trees, model.nodes = model.trees[:kept], model.nodes[:kept]
    return models


def _best(scores: list[float], fewest: int) -> int:
    """The smallest number of trees, ``fewest`` at least, with the highest score."""
    counted = scores[fewest:]
    return fewest + int(np.argmax(counted)) if counted else fewest


def _advanced(rows: DataFrame, width: int, trees: dict[int, list[tuple]]) -> DataFrame:
    """Blocks with the trees' values added to their models' margins."""
    read, (_, values) = block_reader(width, np.uint8), leaf_numbers()
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches):
        for batch in batches:
            moved = []
            for *_, margins, bins, _ in read([batch]):
                margins = margins.copy()
                for m, grown in trees.items():
                    margins[m] += values(bins, grown)
                moved.append(margins.tobytes())
            arrays = [pa.array(moved, pa.binary()) if n == "margins" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, BLOCKS)
