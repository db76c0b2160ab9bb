"""Leaf-wise boosted trees on Spark: rows as bytes, histograms as one aggregate, many models from one scan.

Each scan sums gradients and hessians by (model, leaf, feature, bin). The smaller child of a split is summed, its
sibling follows by subtraction. Trees grow best-first: the leaf with the highest gain is split next, until a tree has
its leaves. A scan looks at the children of several leaves that may be next, which changes the number of scans and not
the trees. Sums are of whole numbers, so that no order of tasks changes a split.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.frames import placed, written
from pricetide.operators.trees import DEFAULT_LEFT, MISSING_SHIFT, NAN_MISSING, Tree, TreeModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Gradients and hessians are counted in units of 1 / SCALE.
SCALE = 1 << 24
#: Bins of a feature, with one for missing values, which is the lowest.
WIDTH = 256
#: Cells of the histograms that a task holds, and nodes of a tree whose histograms one scan makes at most.
MOST_CELLS, MOST_NODES = 1 << 22, 16
#: Rounds after which the rows' scores are written; later trees are walked anew in each scan.
REFRESH = 10
#: Models that share a scan.
MOST_MODELS = 128
#: Rows of the training travel in blocks, each a row of a few byte strings: rows and bytes of a block, about.
BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 1 << 18


@dataclass(frozen=True)
class LeafwiseParams:
    """Training settings; the defaults are the published ones. `depth` below 1 means no limit."""

    rounds: int = 500
    leaves: int = 64
    depth: int = -1
    min_rows: int = 200
    rate: float = 0.1
    l1: float = 0.5
    l2: float = 0.5
    column_share: float = 0.9
    row_share: float = 0.9
    bins: int = 255
    min_hessian: float = 1e-3
    seed: int = 42


def cut_points(rows: DataFrame, features: list[str], bins: int = 255) -> list[np.ndarray]:
    """Highest value of each bin of each feature, rising."""
    return [upper for _, upper in cut_ranges(rows, features, bins)]


def cut_ranges(rows: DataFrame, features: list[str], bins: int = 255) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lowest and highest values of the bins of each feature, rising.

    A feature with up to `bins` values has a bin for each. Otherwise a value is in the bin floor(bins * share of the
    rows with lower values), so bins hold about equal numbers of rows. Values are counted first and put in global order;
    places are sums over parts, so no feature passes through one task.
    """
    values = [F.struct(F.lit(i).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for i, f in enumerate(features)]
    counts = rows.select(F.explode(F.array(*values)).alias("v")).select("v.*").where("value IS NOT NULL AND NOT isnan(value)")
    counts = written(counts.groupBy("feature", "value").agg(F.count("*").alias("n")), "values")
    ordered = placed(counts, ["feature", "value"], unique=True)
    parts = ordered.groupBy("feature", "_part").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    before = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    parts = parts.select(  # a row for each part and feature
        "feature", "_part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("values").over(before), F.lit(0)).alias("values_before"),
        F.sum("rows").over(whole).alias("all_rows"), F.sum("values").over(whole).alias("all_values"),
    )
    own = Window.partitionBy("_part", "feature").orderBy("value")
    lower = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("rows_before")
    place = F.row_number().over(own) - 1 + F.col("values_before")
    number = F.when(F.col("all_values") <= bins, place).otherwise(F.expr(f"{bins}L * lower div all_rows"))
    placed_ = ordered.join(F.broadcast(parts), ["feature", "_part"]).withColumn("lower", lower).withColumn("bin", number)
    ends = placed_.groupBy("feature", "bin").agg(F.min("value").alias("lower"), F.max("value").alias("upper"))
    ends = ends.orderBy("feature", "bin").collect()
    of = lambda i, end: np.array([r[end] for r in ends if r.feature == i], float)
    return [(of(i, "lower"), of(i, "upper")) for i in range(len(features))]


def _bins_of(values: np.ndarray, uppers: np.ndarray) -> np.ndarray:
    """0 for missing values, else 1 + number of the bin; what lies above all bins is in the last."""
    place = np.minimum(np.searchsorted(uppers, values), max(len(uppers) - 1, 0)) + 1
    return np.where(np.isnan(values), 0, place).astype(np.uint8)


def _units(rows: DataFrame, label: str, weight: str | None, fold: str | None) -> list[tuple[int, int, int]]:
    """Weight of each (fold, label) in units of 1 / SCALE."""
    units = F.sum(F.round(_weight(weight) * SCALE).cast("decimal(30,0)")).alias("units")
    sums = rows.groupBy(_fold(fold).alias("part"), F.col(label).cast("int").alias("y")).agg(units)
    return [(r.part, r.y, int(r.units)) for r in sums.collect()]


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _fold(fold: str | None) -> Column:
    return F.lit(0) if fold is None else F.col(fold).cast("int")


@dataclass
class Binned:
    """What trainings on the same rows share: cut points, weights of the classes, and the rows as bytes."""

    uppers: list[np.ndarray]
    units: list[tuple[int, int, int]]
    state: DataFrame


def binned(rows: DataFrame, features: list[str], label: str, weight: str | None = None, fold: str | None = None, key: str = "id", bins: int = 255) -> Binned:
    """Features become bytes once; any number of models can be trained on the result.

    The state is a written table of blocks of rows; a block's columns are byte strings. It has no scores before they
    are written for the first time, as all rows begin with their model's start.
    """
    uppers = cut_points(rows, features, bins)
    columns = [F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("label"), _weight(weight).alias("weight"), _fold(fold).alias("fold")]
    wide = rows.select(*columns, *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    most = _block_rows(len(features), 0)

    def cells(batch: pa.RecordBatch) -> list[np.ndarray]:
        values = [batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(uppers))]
        made = [_bins_of(x, u) for x, u in zip(values, uppers)]
        made = np.stack(made, axis=1) if made else np.empty((batch.num_rows, 0), np.uint8)
        return [*(batch.column(i).to_numpy() for i in range(4)), made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(cells(batch))
            size += batch.num_rows
            if size >= most:
                yield from _state_batches([np.concatenate(x) for x in zip(*held)], most)
                held, size = [], 0
        if size:
            yield from _state_batches([np.concatenate(x) for x in zip(*held)], most)

    return Binned(uppers, _units(rows, label, weight, fold), written(wide.mapInArrow(run, STATE), "booster-state"))


STATE = "size int, key binary, label binary, weight binary, fold binary, bins binary, raw binary"
KINDS = (np.int64, np.int32, np.float64, np.int32, np.uint8, np.float64)


def _block_rows(features: int, models: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (24 + features + 8 * models)))


def _state_batches(columns: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to `most` rows of (key, label, weight, fold, cells) and the scores, if there are any."""
    for low in range(0, len(columns[0]), most):
        parts = [np.ascontiguousarray(x[low : low + most], kind) for x, kind in zip(columns, KINDS)]
        values = [x.tobytes() for x in parts] + [b""] * (len(KINDS) - len(parts))
        arrays = [pa.array([len(parts[0])], pa.int32()), *(pa.array([x], pa.binary()) for x in values)]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in STATE.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(key, label, weight, fold, cells, raw) of each block; `raw` has no columns before the first refresh."""
    for batch in batches:
        for i in range(batch.num_rows):
            flat = [np.frombuffer(batch.column(j + 1)[i].as_buffer(), kind) for j, kind in enumerate(KINDS)]
            size = batch.column(0)[i].as_py()
            yield [*flat[:4], *(x.reshape(size, -1) for x in flat[4:])]


@dataclass
class Walk:
    """A tree over bins, as arrays; children below zero are leaves."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Number of the leaf of each of the rows, which are numbers of rows of `cells`."""
        found = np.zeros(len(rows), np.int64)
        if not len(self.feature):
            return found
        flat, at = cells.reshape(-1), rows * cells.shape[1]
        moving, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        while len(moving):
            goes_left = flat.take(at + self.feature.take(node)) <= self.bin.take(node)
            node = np.where(goes_left, self.left.take(node), self.right.take(node))
            inside = node >= 0
            if not inside.all():
                found[moving[~inside]] = -1 - node[~inside]
                moving, node, at = moving[inside], node[inside], at[inside]
        return found


@dataclass
class Task:
    """What a scan does for one model: its rows, the trees since its scores were written, and the leaves it sums."""

    model: int
    fold: int  # rows that are left out; -1: none
    row_share: float
    seed: int
    start: float
    recent: list[Walk]
    walk: Walk  # of the growing tree
    slots: np.ndarray  # place of a leaf's histogram, -1: none
    features: list[int]


def _sampled(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A share of the rows, by a digest of the key and the seed."""
    x = key.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return (x >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def _scores(model: int, start: float, recent: list[Walk], cells: np.ndarray, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of the rows after all trees: the written ones and what later trees add."""
    written_ = raw[rows, model] if raw.shape[1] else np.full(len(rows), start)
    return written_ + sum((w.value[w.leaves(cells, rows)] for w in recent), np.zeros(len(rows)))


def _histograms(state: DataFrame, tasks: list[Task], width: int) -> dict[tuple[int, int], np.ndarray]:
    """One scan: (model, slot) to sums [feature, bin, (gradient, hessian, rows)] of `width` features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(t.features), 3, (t.slots.max() + 1) * WIDTH), np.int64) for t in tasks]
        for key, label, weight, fold, cells, raw in _blocks(batches):
            for t, held in zip(tasks, sums):
                chosen = np.flatnonzero((fold != t.fold) & _sampled(key, t.seed, t.row_share))
                slot = t.slots[t.walk.leaves(cells, chosen)]
                chosen, slot = chosen[slot >= 0], slot[slot >= 0]
                if not len(chosen):
                    continue
                inner, y, w = cells[chosen], label[chosen], weight[chosen]
                p = 1 / (1 + np.exp(-_scores(t.model, t.start, t.recent, cells, raw, chosen)))
                units = np.rint((p - y) * w * SCALE), np.rint(p * (1 - p) * w * SCALE), None
                for i, f in enumerate(t.features):
                    place = slot * WIDTH + inner[:, f]
                    for j, unit in enumerate(units):
                        held[i, j] += np.bincount(place, unit, held.shape[2]).astype(np.int64)
        for t, held in zip(tasks, sums):
            f, place = np.nonzero(held[:, 2])
            g, h, n = (held[f, j, place] for j in range(3))
            where = [np.full(len(f), t.model), place // WIDTH, np.array(t.features)[f], place % WIDTH]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in where), *map(pa.array, (g, h, n))], names)

    names = ["model", "slot", "feature", "bin", "g", "h", "n"]
    schema = "model int, slot int, feature int, bin int, g long, h long, n long"
    sums = state.mapInArrow(run, schema).groupBy(*names[:4]).agg(*(F.sum(c).alias(c) for c in names[4:])).toArrow()
    model, slot, feature, bin_, g, h, n = (sums[c].to_numpy() for c in names)
    out = {(t.model, s): np.zeros((width, WIDTH, 3), np.int64) for t in tasks for s in range(t.slots.max() + 1)}
    order = np.lexsort((slot, model))
    cuts = np.flatnonzero(np.diff(model[order]) | np.diff(slot[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        out[int(model[part[0]]), int(slot[part[0]])][feature[part], bin_[part]] = np.stack([g[part], h[part], n[part]], axis=1)
    return out


@dataclass
class Node:
    sums: np.ndarray  # histogram [feature, bin, 3]
    total: np.ndarray
    depth: int
    split: tuple[float, int, int] | None = None  # gain, feature, bin
    children: tuple[int, int] | None = None


def _strength(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """What a leaf with these sums gains: the penalised gradient's square over the penalised hessian."""
    kept = np.maximum(np.abs(g) - l1, 0.0)
    return kept * kept / np.maximum(h + l2, 1e-300)


def leaf_value(total: np.ndarray, p: LeafwiseParams) -> float:
    g, h = float(total[0]) / SCALE, float(total[1]) / SCALE
    return -float(np.sign(g) * max(abs(g) - p.l1, 0.0) / max(h + p.l2, 1e-300)) * p.rate


def best_split(sums: np.ndarray, total: np.ndarray, features: list[int], p: LeafwiseParams) -> tuple[float, int, int] | None:
    """The split with the highest gain; of equal ones that of the first feature, then the lowest bin."""
    left = np.cumsum(sums[features], axis=1)[:, :-1]
    right = total - left
    fits = (np.minimum(left, right)[..., 2] >= max(p.min_rows, 1)) & (np.minimum(left, right)[..., 1] >= p.min_hessian * SCALE)
    if not fits.any():
        return None
    side = lambda s: _strength(s[..., 0] / SCALE, s[..., 1] / SCALE, p.l1, p.l2)
    gain = np.where(fits, side(left) + side(right) - side(total), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), features[f], int(b)) if gain[f, b] > 0 else None


class Growing:
    """One tree of one model; `nodes` also has children of leaves that may not be split in the end."""

    def __init__(self, p: LeafwiseParams, features: list[int]):
        self.p, self.features, self.nodes = p, features, []
        self.open: list[int] = []  # nodes whose children are to be summed

    def add(self, sums: np.ndarray, depth: int) -> int:
        total = sums[self.features[0]].sum(axis=0)
        node = Node(sums, total, depth)
        if self.p.depth < 1 or depth < self.p.depth:
            node.split = best_split(sums, total, self.features, self.p)
        self.nodes.append(node)
        return len(self.nodes) - 1

    def committed(self) -> tuple[list[tuple[int, int]], dict[int, int], list[int]]:
        """Splits in order (leaf number, node), nodes of the leaves, and the nodes to look at if it cannot go on."""
        splits, leaf_of = [], {0: 0}
        while len(leaf_of) < self.p.leaves:
            order = sorted((-self.nodes[n].split[0], leaf, n) for leaf, n in leaf_of.items() if self.nodes[n].split)
            if not order:
                break
            _, leaf, n = order[0]
            if self.nodes[n].children is None:
                left = self.p.leaves - len(leaf_of)
                return splits, leaf_of, [n for _, _, n in order[:left] if self.nodes[n].children is None]
            splits.append((leaf, n))
            leaf_of[leaf], leaf_of[len(leaf_of)] = self.nodes[n].children
        return splits, leaf_of, []

    def walk(self) -> tuple[Walk, np.ndarray]:
        """The way to the smaller child of each open node; the second array has slots of leaves."""
        feature, bin_, left, right, slots = [], [], [], [], []
        wanted = set(self.open)  # and all nodes above them: rows elsewhere need not be followed
        for n in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            if wanted.intersection(self.nodes[n].children or ()):
                wanted.add(n)

        def visit(n: int) -> int:
            node = self.nodes[n]
            if n not in wanted:
                slots.append(-1)
                return -len(slots)
            place = len(feature)
            feature.append(node.split[1])
            bin_.append(node.split[2])
            left.append(0)
            right.append(0)
            if node.children is not None:
                left[place], right[place] = visit(node.children[0]), visit(node.children[1])
            else:
                small = self._small(n)
                for side, held in ((0, left), (1, right)):
                    slots.append(self.open.index(n) if side == small else -1)
                    held[place] = -len(slots)
            return place

        if self.nodes:
            visit(0)
        else:
            slots.append(0)  # the root
        arrays = [np.array(x, np.int64) for x in (feature, bin_, left, right)]
        return Walk(*arrays, np.zeros(len(slots))), np.array(slots, np.int64)

    def _small(self, n: int) -> int:
        """Side of the child with fewer rows."""
        node = self.nodes[n]
        inside = int(node.sums[node.split[1], : node.split[2] + 1, 2].sum())
        return 0 if 2 * inside <= node.total[2] else 1

    def fill(self, sums: list[np.ndarray]) -> None:
        """Histograms of the smaller children of the open nodes; the others by subtraction."""
        if not self.nodes:
            self.add(sums[0], 0)
            return
        for n, small in zip(self.open, sums):
            node = self.nodes[n]
            both = (small, node.sums - small) if self._small(n) == 0 else (node.sums - small, small)
            node.children = tuple(self.add(s, node.depth + 1) for s in both)
        self.open = []

    def tree(self, uppers: list[np.ndarray]) -> tuple[Walk, Tree]:
        splits, leaf_of, _ = self.committed()
        where = {n: i for i, (_, n) in enumerate(splits)}
        leaves = {n: leaf for leaf, n in leaf_of.items()}
        child = lambda n: where[n] if n in where else ~leaves[n]
        nodes = [self.nodes[n] for _, n in splits]
        ints = lambda values: np.array(list(values), np.int64)
        feature, bin_ = ints(x.split[1] for x in nodes), ints(x.split[2] for x in nodes)
        sides = [ints(child(x.children[i]) for x in nodes) for i in (0, 1)]
        ends = [self.nodes[leaf_of[i]] for i in range(len(leaf_of))]
        value = np.array([leaf_value(x.total, self.p) for x in ends])
        lowest = -np.finfo(float).max  # only missing values lie below
        threshold = np.array([uppers[f][b - 1] if b else lowest for f, b in zip(feature, bin_)], float)
        kind = np.full(len(nodes), DEFAULT_LEFT | NAN_MISSING << MISSING_SHIFT, np.int64)
        counts, gains = ints(x.total[2] for x in nodes), np.array([x.split[0] for x in nodes], float)
        made = Tree(feature, threshold, *sides, kind, gains, counts, value, ints(x.total[2] for x in ends), self.p.rate)
        return Walk(feature, bin_, *sides, value), made


@dataclass
class Model:
    params: LeafwiseParams
    fold: int
    start: float
    trees: list[Tree] = field(default_factory=list)
    walks: list[Walk] = field(default_factory=list)


def _starts(units: list[tuple[int, int, int]], folds: list[int]) -> list[float]:
    """Log odds of the label among the rows outside each fold."""
    out = []
    for own in folds:
        share = [sum(u for f, y, u in units if f != own and y == side) for side in (0, 1)]
        out.append(float(np.log(max(share[1], 1) / max(share[0], 1))))
    return out


def _refreshed(state: DataFrame, models: list[Model], since: int, features: int) -> DataFrame:
    """The state with the scores of all trees so far."""
    recent = [(i, m.start, m.walks[since:]) for i, m in enumerate(models)]
    most = _block_rows(features, len(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, cells, raw in _blocks(batches):
            rows = np.arange(len(cells))
            scores = np.stack([_scores(*own, cells, raw, rows) for own in recent], axis=1)
            yield from _state_batches([*columns, cells, scores], most)

    return written(state.mapInArrow(run, STATE), "booster-state")


@dataclass
class Trained:
    models: list[Model]
    uppers: list[np.ndarray]
    state: DataFrame  # as of the last refresh
    since: int
    scans: int


def grow(
    rows: DataFrame,
    features: list[str],
    jobs: list[tuple[LeafwiseParams, int]],
    label: str,
    weight: str | None = None,
    fold: str | None = None,
    key: str = "id",
    data: Binned | None = None,
) -> Trained:
    """Train a model for each job (settings, fold that is left out, -1 for none), all from the same scans.

    The number of scans depends on rounds and the depth of the deepest tree, not on the number of jobs; up to MOST_MODELS
    jobs are taken. The driver holds the histograms of the growing trees: 256 bins per leaf, feature and model. Rows
    need a `key` that tells them apart for the row share; rows with equal keys are drawn together. `data` are the same
    rows, binned before with the same label, weight and folds.
    """
    if not 0 < len(jobs) <= MOST_MODELS:
        raise ValueError(f"1 to {MOST_MODELS} models share a scan")
    if max(p.bins for p, _ in jobs) >= WIDTH:
        raise ValueError(f"bins must be below {WIDTH}")
    data = data or binned(rows, features, label, weight, fold, key, jobs[0][0].bins)
    uppers, state = data.uppers, data.state
    models = [Model(p, f, s) for (p, f), s in zip(jobs, _starts(data.units, [f for _, f in jobs]))]
    since = scans = 0
    nodes = max(1, min(MOST_NODES, MOST_CELLS // (len(jobs) * max(len(features), 1) * WIDTH * 3)))
    for turn in range(max(p.rounds for p, _ in jobs)):
        growing = {}
        for i, m in enumerate(models):
            if turn < m.params.rounds:
                size = max(1, min(len(features), round(m.params.column_share * len(features))))
                drawn = sorted(random.Random(m.params.seed * 1_000_003 + turn).sample(range(len(features)), size))
                growing[i] = Growing(m.params, drawn)
        waiting = list(growing)
        while waiting:
            tasks = []
            for i in waiting:
                m, g = models[i], growing[i]
                tasks.append(Task(i, m.fold, m.params.row_share, m.params.seed * 65_537 + turn, m.start, m.walks[since:], *g.walk(), g.features))
            found = _histograms(state, tasks, len(features))
            scans += 1
            for t in tasks:
                growing[t.model].fill([found[t.model, s] for s in range(int(t.slots.max()) + 1)])
            waiting = []
            for i, g in growing.items():
                g.open = g.committed()[2][:nodes]
                if g.open:
                    waiting.append(i)
        for i, g in growing.items():
            walk, tree = g.tree(uppers)
            models[i].walks.append(walk)
            models[i].trees.append(tree)
        if turn + 1 - since >= REFRESH:
            state, since = _refreshed(state, models, since, len(features)), turn + 1
    return Trained(models, uppers, state, since, scans)


def as_model(model: Model, features: list[str], uppers: list[np.ndarray]) -> TreeModel:
    """The trees as a model of their own; the first tree's leaves take the starting score."""
    first, *rest = model.trees
    first = replace(first, value=first.value + model.start)
    infos = [f"[{u[0]!r}:{u[-1]!r}]".replace("np.float64(", "").replace(")", "") if len(u) else "none" for u in uppers]
    return TreeModel(list(features), [first, *rest], 1.0, infos)


def train_leafwise(
    rows: DataFrame,
    features: list[str],
    label: str,
    params: LeafwiseParams = LeafwiseParams(),
    weight: str | None = None,
    key: str = "id",
    data: Binned | None = None,
) -> TreeModel:
    """Boosted trees of a 0/1 label; missing feature values go left at every split."""
    trained = grow(rows, features, [(params, -1)], label, weight, key=key, data=data)
    return as_model(trained.models[0], features, trained.uppers)


# The searched settings, 576 points.
SEARCH_SPACE = {
    "rate": [0.01, 0.05, 0.1],
    "leaves": [31, 64],
    "depth": [-1, 5, 7],
    "min_rows": [100, 200],
    "column_share": [0.7, 0.9],
    "row_share": [0.7, 0.9],
    "l1": [0.0, 0.5],
    "l2": [0.0, 0.5],
}


def search_points(n_iter: int, seed: int, space: dict[str, list] = SEARCH_SPACE) -> list[dict]:
    """Seeded draw of distinct points of the grid; all of them where fewer than `n_iter` exist."""
    points = [dict(zip(space, values)) for values in product(*space.values())]
    return random.Random(seed).sample(points, min(n_iter, len(points)))


def fold_losses(trained: Trained) -> list[float]:
    """Weighted log loss of each model on the fold that it has not seen, from one scan."""
    tasks = [(i, m.fold, m.start, m.walks[trained.since :]) for i, m in enumerate(trained.models)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tasks), 2))
        for _, label, weight, fold, cells, raw in _blocks(batches):
            for i, own, start, recent in tasks:
                rows = np.flatnonzero(fold == own)
                z = _scores(i, start, recent, cells, raw, rows)
                loss = np.logaddexp(0, np.where(label[rows] == 1, -z, z))
                sums[i] += (weight[rows] * loss).sum(), weight[rows].sum()
        arrays = [pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        yield pa.RecordBatch.from_arrays(arrays, ["model", "loss", "weight"])

    sums = trained.state.mapInArrow(run, "model int, loss double, weight double").groupBy("model")
    found = {r.model: r.loss / r.weight for r in sums.agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight")).collect() if r.weight}
    return [found.get(i, float("nan")) for i in range(len(trained.models))]


@dataclass
class Search:
    points: list[dict]
    losses: list[float]  # mean over the folds
    scans: int
    model: TreeModel
    data: Binned

    @property
    def best(self) -> int:
        return min(range(len(self.losses)), key=self.losses.__getitem__)


def search_leafwise(
    rows: DataFrame,
    features: list[str],
    label: str,
    weight: str | None = "weight",
    fold: str = "fold",
    folds: int = 4,
    n_iter: int = 50,
    seed: int = 42,
    rounds: int = 100,
    space: dict[str, list] = SEARCH_SPACE,
    key: str = "id",
) -> Search:
    """Random search by cross-validated log loss; the best point is trained again on all rows.

    Every scan sums the histograms of up to MOST_MODELS models (points by folds), so a search over many points reads
    the rows as often as one training does. More models than that are taken in turns. All share the binned rows.
    """
    points = search_points(n_iter, seed, space)
    base = LeafwiseParams(rounds=rounds, seed=seed)
    jobs = [(replace(base, **point), f) for point in points for f in range(folds)]
    data = binned(rows, features, label, weight, fold, key, jobs[0][0].bins)
    losses, scans = [], 0
    for low in range(0, len(jobs), MOST_MODELS):
        trained = grow(rows, features, jobs[low : low + MOST_MODELS], label, weight, fold, key, data)
        losses += fold_losses(trained)
        scans += trained.scans
    means = [float(np.mean(losses[i * folds : (i + 1) * folds])) for i in range(len(points))]
    best = min(range(len(points)), key=means.__getitem__)
    model = train_leafwise(rows, features, label, replace(base, **points[best]), weight, key, data)
    return Search(points, means, scans, model, data)
