"""Spark's boosted classification trees, learnt over rows as bytes: no row is an object in memory, none is cached.

The method is that of `GBTClassifier`: a first regression tree on labels of -1 and 1, then trees on what the log loss
leaves, level by level, by the gain in variance; rows are drawn anew for each tree, features for each node. Cut points
come from all rows. Sums are of whole numbers, so that no order of tasks changes a split.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.frames import written
from pricetide.operators.leafwise import SCALE, WIDTH, cut_ranges
from pricetide.session import remove_path, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Rows of a block, which is a row of the written state, and cells of the histograms that a task holds.
BLOCK_ROWS, MOST_CELLS = 1 << 14, 1 << 22
#: Tasks whose histograms the driver adds up itself; those of more tasks are added up in a shuffle.
MOST_TASKS = 64
STATE = "block long, label binary, bins binary, raw binary"


@dataclass
class Node:
    """A node of a growing tree; `sums` is its histogram [feature, bin, (rows, gradient, its square)]."""

    total: np.ndarray
    sums: np.ndarray | None = None
    split: tuple[float, int, int] | None = None  # gain, feature, bin
    children: tuple[int, int] | None = None


def _state(rows: DataFrame, features: list[str], label: str, uppers: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: labels, bins by feature, and no scores yet."""

    def block(number: int, y: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        if not np.isin(y, (0, 1)).all():
            raise ValueError(f"{label} must be 0 or 1")
        if any(np.isnan(x).any() for x in values):
            raise ValueError("a feature of a training row is missing")
        bins = np.stack([np.searchsorted(u, x) for u, x in zip(uppers, values)]).astype(np.uint8)
        columns = [[number], [y.astype(np.uint8).tobytes()], [bins.tobytes()], [b""]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns])
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                y, *values = [np.concatenate(x) for x in zip(*held)]
                whole = size // BLOCK_ROWS * BLOCK_ROWS
                for low in range(0, whole, BLOCK_ROWS):
                    yield block(number, y[low : low + BLOCK_ROWS], [x[low : low + BLOCK_ROWS] for x in values])
                    number += 1
                held, size = [[x[whole:] for x in (y, *values)]], size - whole
        if size:
            y, *values = [np.concatenate(x) for x in zip(*held)]
            yield block(number, y, values)

    names, kinds = [c.split()[0] for c in STATE.split(", ")], [pa.int64(), *[pa.binary()] * 3]
    wide = rows.select(F.col(label).cast("double").alias("label"), *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    return written(wide.mapInArrow(run, STATE), "boosting-state")


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, labels of -1 and 1, bins [feature, row], scores) of each block; no scores before the first tree."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((1, np.uint8), (2, np.uint8), (3, np.float64))]
            yield batch.column(0)[i].as_py(), parts[0] * 2.0 - 1.0, parts[1].reshape(features, -1), parts[2]


def _drawn(block: int, size: int, seed: int, share: float) -> np.ndarray:
    """Numbers of a share of the block's rows, by a digest of their places and the seed."""
    if share >= 1:
        return np.arange(size)
    x = np.arange(size, dtype=np.uint64) + np.uint64((block * BLOCK_ROWS + seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(30)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.flatnonzero((x >> np.uint64(11)) < np.uint64(int(share * (1 << 53))))


@dataclass
class Walk:
    """A tree over bins, as arrays by node; the right child comes after the left one, and a leaf leads to itself."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    depth: int

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        size, flat = bins.shape[1], bins.reshape(-1)
        if not self.depth:
            return np.zeros(size, np.int64)
        node = self.left[0] + (bins[self.feature[0]] > self.bin[0])
        first, rows = self.feature * size, np.arange(size)
        for _ in range(self.depth - 1):
            at = first.take(node)
            at += rows
            right = flat.take(at) > self.bin.take(node)
            node = self.left.take(node)
            node += right
        return node


def _walk(nodes: list[Node], depth: int) -> Walk:
    split = [n.split if n.children else (0.0, 0, WIDTH - 1) for n in nodes]
    left = np.array([n.children[0] if n.children else k for k, n in enumerate(nodes)], np.int64)
    return Walk(np.array([s[1] for s in split], np.int64), np.array([s[2] for s in split], np.uint8), left, depth)


def _left_over(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """What a tree is fitted to: the labels at first, then the negative gradient of the log loss."""
    return 4 * y / (1 + np.exp(2 * y * raw)) if len(raw) else y


def _histograms(state: DataFrame, spread: bool, features: int, walk: Walk, slots: np.ndarray, seed: int, share: float) -> np.ndarray:
    """One scan: [slot, feature, bin, (rows, gradient, its square)] of the drawn rows that end in nodes with a slot."""
    wanted = int(slots.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, features, wanted * WIDTH), np.int64)
        for block, y, bins, raw in _blocks(batches, features):
            rows = _drawn(block, len(y), seed, share)
            slot = slots.take(walk.ends(bins)).take(rows)
            if len(slots) > 1:
                inside = np.flatnonzero(slot >= 0)
                rows, slot = rows.take(inside), slot.take(inside)
            left = _left_over(y[rows], raw[rows] if len(raw) else raw)
            units = np.rint(left * SCALE), np.rint(left * left * SCALE)
            place = slot * WIDTH
            for f in range(features):
                at = place + bins[f].take(rows)
                held[0, f] += np.bincount(at, minlength=wanted * WIDTH)
                held[1, f] += np.bincount(at, units[0], wanted * WIDTH).astype(np.int64)
                held[2, f] += np.bincount(at, units[1], wanted * WIDTH).astype(np.int64)
        n, g, q = held.reshape(3, -1)
        keys = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, n[keys], g[keys], q[keys])], names)

    names = ["key", "n", "g", "q"]
    found = state.mapInArrow(run, "key long, n long, g long, q long")
    if spread:
        found = found.groupBy("key").agg(*(F.sum(c).alias(c) for c in names[1:]))
    out = np.zeros((features * wanted * WIDTH, 3), np.int64)
    for batch in found.toArrow().to_batches():
        key, *sums = (batch.column(c).to_numpy() for c in names)
        np.add.at(out, key, np.stack(sums, axis=1))
    return out.reshape(features, wanted, WIDTH, 3).transpose(1, 0, 2, 3)


def _best_split(node: Node, features: list[int], min_rows: int) -> tuple[float, int, int] | None:
    """The split that takes most variance; of equal ones that of the first feature, then the lowest bin."""
    left = np.cumsum(node.sums[features], axis=1)[:, :-1]
    right = node.total - left
    fits = np.minimum(left[..., 0], right[..., 0]) >= max(min_rows, 1)
    if not fits.any():
        return None
    side = lambda s: (s[..., 1] / SCALE) ** 2 / np.maximum(s[..., 0], 1)
    gain = np.where(fits, side(left) + side(right) - side(node.total), -np.inf) / node.total[0]
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), features[f], int(b)) if gain[f, b] > 0 else None


def _tree(state: DataFrame, spread: bool, features: int, p, turn: int) -> tuple[list[Node], Walk]:
    """A tree of the drawn rows, level by level: of two children the one with fewer rows is summed, the other subtracted."""
    at_a_time = max(1, MOST_CELLS // (max(features, 1) * WIDTH * 3))
    own = random.Random(p.seed * 1_000_003 + turn)
    size = max(1, min(features, ceil(p.column_share * features)))
    seed = p.seed * 65_537 + turn

    def add(sums: np.ndarray) -> Node:
        node = Node(sums[0].sum(axis=0), sums)
        drawn = sorted(own.sample(range(features), size))
        node.split = _best_split(node, drawn, p.min_rows) if node.total[0] else None
        return node

    root = Walk(*(np.zeros(1, np.int64) for _ in range(3)), 0)
    nodes = [add(_histograms(state, spread, features, root, np.zeros(1, np.int64), seed, p.row_share)[0])]
    level = [0]
    for depth in range(1, p.depth + 1):
        parents, level = [n for n in level if nodes[n].split], []
        smaller = []
        for n in parents:
            node = nodes[n]
            _, f, b = node.split
            inside = node.sums[f, : b + 1].sum(axis=0)
            node.children = (len(nodes), len(nodes) + 1)
            nodes += [Node(inside), Node(node.total - inside)]
            level += node.children
            smaller.append(node.children[int(2 * inside[0] > node.total[0])])
        walk = _walk(nodes, depth)
        if depth < p.depth:
            for low in range(0, len(parents), at_a_time):
                some = range(low, min(low + at_a_time, len(parents)))
                slots = np.full(len(nodes), -1, np.int64)
                slots[[smaller[i] for i in some]] = np.arange(len(some))
                for i, sums in zip(some, _histograms(state, spread, features, walk, slots, seed, p.row_share)):
                    node = nodes[parents[i]]
                    for child in node.children:
                        nodes[child] = add(sums if child == smaller[i] else node.sums - sums)
        for n in parents:
            nodes[n].sums = None
        if not parents:
            break
    return nodes, _walk(nodes, p.depth)


def _scored(state: DataFrame, features: int, walk: Walk, values: np.ndarray, path: str) -> DataFrame:
    """The state with what a tree adds to the scores, written to the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for _, y, bins, raw in _blocks(iter([batch]), features):
                added = values.take(walk.ends(bins))
                made.append((raw + added if len(raw) else added).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], batch.schema.names)

    state.mapInArrow(run, STATE).write.parquet(path, compression="none")
    return state.sparkSession.read.schema(state.schema).parquet(path)


def _value(node: Node) -> float:
    return float(node.total[1]) / SCALE / float(node.total[0]) if node.total[0] else 0.0


def _as_spark(jvm, gateway, trees: list[list[Node]], thresholds: list[np.ndarray], uid: str):
    """The trees as Spark's, from their nodes."""
    ml, double = jvm.org.apache.spark.ml, jvm.double
    leaf, inner, point = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    variance, model = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, ml.regression.DecisionTreeRegressionModel
    made = gateway.new_array(model, len(trees))
    for k, nodes in enumerate(trees):
        below = {}
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
            node = nodes[i]
            n, g, q = float(node.total[0]), float(node.total[1]) / SCALE, float(node.total[2]) / SCALE
            stats = gateway.new_array(double, 3)
            stats[0], stats[1], stats[2] = n, g, q
            own = _value(node), max((q - g * g / n) / n, 0.0) if n else 0.0
            if node.children is None:
                below[i] = leaf(*own, variance(stats, int(n)))
            else:
                gain, f, b = node.split
                split = point(f, float(thresholds[f][b]))
                below[i] = inner(*own, gain, *(below[c] for c in node.children), split, variance(stats, int(n)))
        made[k] = model(f"{uid}_{k}", below[0], len(thresholds))
    return made


def fit(rows: DataFrame, features: list[str], label: str, p, booster: GBTClassifier) -> GBTClassificationModel:
    """The model that `booster`, set by the parameters `p`, is to fit to the rows; without weights.

    Rows are scanned once for each level of each tree and once to add a tree to their scores; a row takes a byte for
    each feature, one for its label and eight for its score. The driver holds the histograms of one level.
    """
    if p.bins >= WIDTH:
        raise ValueError(f"bins must be below {WIDTH}")
    spark = rows.sparkSession
    ranges = cut_ranges(rows, features, p.bins)
    uppers = [u for _, u in ranges]
    # A split lies halfway between the values beside it.
    thresholds = [(u[:-1] + l[1:]) / 2 for l, u in ranges]
    state = _state(rows, features, label, uppers)
    spread = state.rdd.getNumPartitions() > MOST_TASKS
    width, trees, path = len(features), [], None
    weights = [1.0, *[p.rate] * (p.rounds - 1)]
    for turn in range(p.rounds):
        nodes, walk = _tree(state, spread, width, p, turn)
        if turn == 0 and not nodes[0].total[0]:
            raise ValueError("no rows to train on")
        trees.append(nodes)
        if turn + 1 < p.rounds:
            values = np.array([_value(n) for n in nodes]) * weights[turn]
            before, path = path, scratch_path(spark, "boosting-scores")
            state = _scored(state, width, walk, values, path)
            if before:
                remove_path(spark, before)  # nothing reads the older scores
    if path:
        remove_path(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    made, shares = _as_spark(jvm, gateway, trees, thresholds, booster.uid), gateway.new_array(jvm.double, len(trees))
    for i, weight in enumerate(weights):
        shares[i] = weight
    model = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(booster.uid, made, shares, width, 2))
    booster._copyValues(model)
    model._transfer_params_to_java()
    return model
