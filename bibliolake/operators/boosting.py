"""Boosted trees for two classes, many models at a time.

Features are cut into bins once. Rows are cut into blocks and models are dealt to groups; a
task holds one block with the margins of one group, at most as many margins as
``TASK_ROWS`` rows have of all models. Where one block holds all rows, its task has the whole
sums of its models and grows their trees for many rounds. Where there are more, one pass
over the rows sums the gradients of every open node of every model in each step, and the
driver picks the splits from sums whose number does not depend on the rows. A model of
many rounds holds those of fewer, so settings that differ in rounds share a fit. Missing
values have a bin of their own and go to the better side of each split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import shared_folder

#: Bins of a feature besides the one of missing values, and the error of their bounds.
BINS, QUANTILE_ERROR = 32, 0.001
#: Penalty of leaf values, second derivatives that a child has at least, and gain of a split.
PENALTY, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Rows of a task at most and at least, if it holds all models; rounds between two
#: checkpoints, and tasks and bytes of sums that the driver adds.
TASK_ROWS, LEAST_ROWS, CHECKPOINT_ROUNDS, FAN_IN, SUMS = 65_536, 1_000, 25, 64, 1 << 28

LEAF = -1


@dataclass
class Tree:
    """Nodes in the order they were made, the root first."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for column, x in zip((self.feature, self.cut, self.missing_left, self.left, self.value, self.gain), (LEAF, 0, False, 0, value, 0.0)):
            column.append(x)
        return len(self.value) - 1

    def packed(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.missing_left), np.array(self.left), np.array(self.value)


def _routed(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of every row. A right child comes directly after its left sibling."""
    feature = tree[0]
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node[rows]]
        rows, f = rows[f != LEAF], f[f != LEAF]
        if not len(rows):
            return node
        node[rows] = _children(tree, node[rows], bins[rows, f])


def _children(tree: tuple[np.ndarray, ...], node: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The children that rows go to from nodes with a split, by their bins of its feature."""
    _, cut, missing_left, left, _ = tree
    return left[node] + np.where(b == 0, ~missing_left[node], b > cut[node])


@dataclass(frozen=True)
class Setting:
    """One model: depth, step and the fold it does not learn from, or None."""

    depth: int
    step: float
    held_out: int | None = None


@dataclass
class Boosted:
    """Trees of one model with the bounds of the bins of its features."""

    names: list[str]
    bounds: list[list[float]]
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = _binned(values, [np.array(b) for b in self.bounds])
        total = np.zeros(len(bins))
        for tree in self.trees:
            packed = tree.packed()
            total += packed[4][_routed(packed, bins)]
        return total

    def importances(self) -> list[float]:
        """Mean gain of the splits of each feature, as shares of their sum."""
        gains, splits = np.zeros(len(self.names)), np.zeros(len(self.names))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f != LEAF:
                    gains[f] += g
                    splits[f] += 1
        mean = gains / np.maximum(splits, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()


def _binned(values: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Bin 0 for a missing value, else one more than the bounds below the value."""
    columns = [np.where(np.isnan(v), 0, 1 + np.searchsorted(b, v, "left")) for v, b in zip(values.T, bounds)]
    return np.stack(columns, axis=1).astype(np.uint8) if columns else np.zeros((len(values), 0), np.uint8)


def bin_bounds(df: DataFrame, names: list[str]) -> list[list[float]]:
    """Distinct quantiles of each feature; equal bins hold about equally many rows."""
    shares = [i / BINS for i in range(1, BINS)]
    doubles = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    return [sorted(set(q)) for q in doubles.approxQuantile(names, shares, QUANTILE_ERROR)] if names else []


@dataclass
class _Part:
    """A block of rows with the margins of one group of models, and the trees that these
    models got where the task has grown them."""

    bins: np.ndarray
    y: np.ndarray
    folds: np.ndarray
    margins: np.ndarray
    models: list[int]
    #: Rows of each task that binned them. Their sums are added one after the other, as those
    #: of blocks are, so models do not change in the last digits with the layout.
    lots: list[int]
    trees: list[list[Tree]] = field(default_factory=list)


def _state(df: DataFrame, names: list[str], label: str, fold: str | None, bounds: list[list[float]], models: int) -> RDD:
    """A ``_Part`` for each block of rows and group of models."""
    numbers = [F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]
    marks = [F.col(label).cast("int").alias("y"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold")]
    rows = df.select(*marks, *numbers)
    cuts = [np.array(b) for b in bounds]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
            values = np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))
            parts = (_binned(values, cuts), *(c.to_numpy(zero_copy_only=False).astype(np.int32) for c in batch.columns[:2]))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], ["bins", "y", "fold"])

    # Few rows are dealt to the cores that there are, many to tasks of a fixed size. The
    # tasks have different models first, and different rows if there are more tasks.
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // TASK_ROWS), min(cores, n // LEAST_ROWS))
    groups = min(models, tasks)
    blocks = -(-tasks // groups)

    def copied(task: int, pieces: Iterator) -> Iterator[tuple]:
        for i, b in enumerate(pieces):
            for group in range(groups):
                yield task % blocks * groups + group, (task, i, *b)

    def joined(place: int, pieces: Iterator) -> Iterator[_Part]:
        # In a fixed order, so that a part made again is the same.
        pieces = [b for _, b in sorted(pieces, key=lambda p: p[1][:2])]
        if pieces:
            bins, y, folds = (np.concatenate([np.frombuffer(b[c], t) for b in pieces]) for c, t in ((2, np.uint8), (3, np.int32), (4, np.int32)))
            own = list(range(place % groups, models, groups))
            lots = np.bincount([b[0] for b in pieces], [len(b[3]) // 4 for b in pieces]).astype(int)
            yield _Part(bins.reshape(len(y), -1), y, folds, np.zeros((len(own), len(y))), own, lots[lots > 0].tolist())

    pieces = rows.repartition(tasks).mapInArrow(packed, "bins binary, y binary, fold binary").rdd
    pieces = pieces.mapPartitionsWithIndex(copied)
    if groups > 1:
        pieces = pieces.partitionBy(blocks * groups, int)
    return pieces.mapPartitionsWithIndex(joined)


def _gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _sums(bins: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, lot: np.ndarray | int = 0, lots: int = 1) -> np.ndarray:
    """Sums of both derivatives by feature and cell, a cell being an open node and a bin."""
    size = nodes * (BINS + 1)
    flat, first = np.zeros((2, bins.shape[1], size)), (lot * nodes + place) * (BINS + 1)
    for f in range(bins.shape[1]):
        cell = first + bins[:, f]
        for total, x in zip(flat, (g, h)):
            total[f] = np.bincount(cell, x, lots * size).reshape(lots, size).sum(axis=0)
    return flat


def _histograms(part: _Part, trees: dict, opened: dict, held_out: list[int | None]) -> dict:
    """Of every model of the part the cells of its open nodes that have rows, with the sums
    of both derivatives; a cell is a feature, an open node and a bin."""
    found = {}
    for i, m in enumerate(part.models):
        if m not in opened:
            continue
        nodes = opened[m]
        at = np.full(len(trees[m][0]), -1)
        at[nodes] = np.arange(len(nodes))
        place = at[_routed(trees[m], part.bins)]
        rows = np.flatnonzero((place >= 0) & (part.folds != held_out[m]))
        g, h = _gradients(part.margins[i, rows], part.y[rows])
        flat = _sums(part.bins[rows], place[rows], g, h, len(nodes)).reshape(2, -1)
        cells = np.flatnonzero(flat[1])
        found[m] = (cells, flat[:, cells]) if 2 * len(cells) < flat.shape[1] else (None, flat)
    return found


def _grown(part: _Part, settings: list[Setting], rounds: int) -> _Part:
    """A part that holds all rows after some more rounds of its models."""
    # One feature after the other, as the sums read them.
    bins, margins, trees = np.asfortranarray(part.bins), part.margins.copy(), []
    every_lot = np.repeat(np.arange(len(part.lots)), part.lots)
    for margin, m in zip(margins, part.models):
        learned = np.flatnonzero(part.folds != settings[m].held_out)
        trees.append([])
        for _ in range(rounds):
            tree, opened, level = Tree(), [0], 0
            own, lot, place = bins[learned], every_lot[learned], np.zeros(len(learned), np.int64)
            g, h = _gradients(margin[learned], part.y[learned])
            while opened:
                sums = _sums(own, place, g, h, len(opened), lot, len(part.lots))
                made, level = _split(tree, opened, sums.reshape(2, own.shape[1], len(opened), BINS + 1), settings[m].step), level + 1
                if not made or level >= settings[m].depth:
                    break
                # The rows of nodes with a split go on to the children.
                packed, node = tree.packed(), np.array(opened)[place]
                inner = packed[0][node] != LEAF
                own, lot, g, h, node = (x if inner.all() else x[inner] for x in (own, lot, g, h, node))
                place = np.searchsorted(made, _children(packed, node, own[np.arange(len(node)), packed[0][node]]))
                opened = made
            trees[-1].append(tree)
            packed = tree.packed()
            margin += packed[4][_routed(packed, bins)]
    return replace(part, margins=margins, trees=trees)


def _added(a: dict, b: dict) -> dict:
    """Sums of the histograms of two sets of rows."""

    def one(x: tuple, y: tuple) -> tuple:
        if x[0] is None or y[0] is None:
            dense, other = (x[1], y) if x[0] is None else (y[1], x)
            dense = dense.copy()
            if other[0] is None:
                dense += other[1]
            else:
                dense[:, other[0]] += other[1]
            return None, dense
        cells, place = np.unique(np.concatenate((x[0], y[0])), return_inverse=True)
        both = np.concatenate((x[1], y[1]), axis=1)
        return cells, np.stack([np.bincount(place, r, len(cells)) for r in both])

    return {m: one(a[m], b[m]) if m in a and m in b else a.get(m, b.get(m)) for m in a | b}


def _split(tree: Tree, nodes: list[int], sums: np.ndarray, step: float) -> list[int]:
    """Splits the open nodes of a tree where that gains; the new nodes."""
    g, h = sums
    all_g, all_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
    # Of equal splits the first counts: by feature, by cut, missing values to the right.
    left_g, left_h = (np.cumsum(x[:, :, 1:], axis=2)[:, :, :-1] for x in (g, h))
    left_g = np.stack((left_g, left_g + g[:, :, :1]), axis=3)
    left_h = np.stack((left_h, left_h + h[:, :, :1]), axis=3)
    right_g, right_h = all_g[..., None] - left_g, all_h[..., None] - left_h
    score = lambda a, b: a * a / (b + PENALTY)
    gain = 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)[..., None])
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
    features, _, cuts, _ = gain.shape
    flat = gain.transpose(1, 0, 2, 3).reshape(len(nodes), -1)
    best, made = flat.argmax(axis=1) if flat.shape[1] else None, []
    for i, node in enumerate(nodes):
        total_g, total_h = (all_g[0, i, 0], all_h[0, i, 0]) if features else (0.0, 0.0)
        tree.value[node] = float(-step * total_g / (total_h + PENALTY))
        if best is None or flat[i, best[i]] <= LEAST_GAIN:
            continue
        f, cut, to_left = np.unravel_index(best[i], (features, cuts, 2))
        place = f, i, cut, to_left
        tree.feature[node], tree.cut[node], tree.missing_left[node] = int(f), int(cut) + 1, bool(to_left)
        tree.gain[node] = float(flat[i, best[i]])
        tree.left[node] = len(tree.value)
        for a, b in ((left_g, left_h), (right_g, right_h)):
            made.append(tree.add(float(-step * a[place] / (b[place] + PENALTY))))
    return made


def fit_all(
    df: DataFrame,
    names: list[str],
    label: str,
    settings: list[Setting],
    rounds: list[int],
    fold: str | None = None,
    scores_only: frozenset[int] = frozenset(),
) -> tuple[list[Boosted], dict[tuple[Setting, int], float]]:
    """All models with the most rounds asked for, and the accuracy of each on its held-out
    fold after each of ``rounds``. The margins are kept between rounds and checkpointed now
    and then. Of the models numbered in ``scores_only`` the driver keeps no trees."""
    spark = df.sparkSession
    shared_folder(spark)  # names the folder of the checkpoints
    bounds = bin_bounds(df, names)
    state = _state(df, names, label, fold, bounds, len(settings)).persist(StorageLevel.MEMORY_AND_DISK)
    # Every group of models has as many parts as there are blocks of rows.
    blocks = -(-state.getNumPartitions() // len(settings))
    models = [Boosted(names, bounds, []) for _ in settings]
    scores: dict[tuple[Setting, int], float] = {}
    before, done = None, 0
    while done < max(rounds):
        stop = min([n for n in rounds if n > done] + [(done // CHECKPOINT_ROUNDS + 1) * CHECKPOINT_ROUNDS])
        if blocks == 1:
            count = stop - done
            after = state.map(lambda part, count=count: _grown(part, settings, count)).persist(StorageLevel.MEMORY_AND_DISK)
            if stop % CHECKPOINT_ROUNDS == 0:
                after.checkpoint()
            grown = {}
            for made in after.map(lambda part: {m: t for m, t in zip(part.models, part.trees) if m not in scores_only}).collect():
                grown |= made
            state.unpersist()
            state, done = after, stop
        else:
            trees = _round(state, names, settings, before)
            grown = {m: [t] for m, t in enumerate(trees) if m not in scores_only}
            packed = [t.packed() for t in trees]

            def moved(part: _Part, packed=packed) -> _Part:
                more = np.stack([packed[m][4][_routed(packed[m], part.bins)] for m in part.models])
                return replace(part, margins=part.margins + more)

            before, state, done = state, state.map(moved).persist(StorageLevel.MEMORY_AND_DISK), done + 1
            if done % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
        for m, made in grown.items():
            models[m].trees += made
        if done in rounds:
            scores |= {(s, done): v for s, v in zip(settings, _accuracies(state, settings)) if v is not None}
    if before is not None:
        before.unpersist()
    state.unpersist()
    return models, scores


def _round(state: RDD, names: list[str], settings: list[Setting], before: RDD | None) -> list[Tree]:
    """One tree of each model, with one pass over the blocks of rows for each level."""
    tasks, width = state.getNumPartitions(), BINS + 1
    held_out = [s.held_out for s in settings]
    trees = [Tree() for _ in settings]
    opened, level = {m: [0] for m in range(len(settings))}, 0
    while opened:
        # A few kilobytes, which travel with the task.
        sent = {m: trees[m].packed() for m in opened}, opened, held_out
        parts = state.map(lambda part, sent=sent: _histograms(part, *sent))
        room = 16 * width * len(names) * sum(map(len, opened.values()))
        sums = parts.treeReduce(_added) if tasks > FAN_IN or tasks * room > SUMS else parts.reduce(_added)
        if before is not None:  # by now the margins of this round are kept
            before.unpersist()
            before = None
        after, level = {}, level + 1
        for m, nodes in opened.items():
            cells, values = sums[m]
            dense = values
            if cells is not None:
                dense = np.zeros((2, len(names) * len(nodes) * width))
                dense[:, cells] = values
            made = _split(trees[m], nodes, dense.reshape(2, len(names), len(nodes), width), settings[m].step)
            if made and level < settings[m].depth:
                after[m] = made
        opened = after
    return trees


def _accuracies(state: RDD, settings: list[Setting]) -> list[float | None]:
    def counted(part: _Part) -> np.ndarray:
        found = np.zeros((2, len(settings)), np.int64)
        for margin, m in zip(part.margins, part.models):
            held = part.folds == (-1 if settings[m].held_out is None else settings[m].held_out)
            found[:, m] = (((margin > 0) == part.y) & held).sum(), held.sum()
        return found

    right, all_rows = state.map(counted).reduce(lambda a, b: a + b)
    return [r / n if n else None for r, n in zip(right.tolist(), all_rows.tolist())]
