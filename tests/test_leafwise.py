from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import leafwise as lw
from pricetide.operators import trees as tr
from pricetide.sources import tables, writers

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = []
    for i in range(1500):
        a, b, c = rng.randrange(40), rng.random(), rng.choice([0.0, 1.0, 2.0])
        odds = (a > 20) * 1.5 + (b > 0.6) * (c == 1) * 2 - 1.2
        made.append((i, float(a), None if i % 50 == 0 else b, c, int(rng.random() < 1 / (1 + np.exp(-odds))), 1.0 + i % 3, i % 3))
    return spark.createDataFrame(made, "id long, a double, b double, c double, y int, w double, fold int").repartition(5).cache()


def bins_of(values, bins):
    """Bins by the rule of the docstring, from all values in order; missing values are in bin 0."""
    known = sorted(v for v in values if v is not None)
    distinct = sorted(set(known))
    lower = {v: sum(k < v for k in known) for v in distinct}
    cut = {v: i if len(distinct) <= bins else bins * lower[v] // len(known) for i, v in enumerate(distinct)}
    numbers = {c: i + 1 for i, c in enumerate(sorted(set(cut.values())))}
    return [0 if v is None else numbers[cut[v]] for v in values], len(numbers)


def plain_trees(data, p, rounds, columns_of):
    """One leaf split after the other, each from its own rows; returns splits by tree and the raw scores."""
    cells = np.array([bins_of([r[f] for r in data], p.bins)[0] for f in FEATURES]).T
    y, w = np.array([r["y"] for r in data]), np.array([r["w"] for r in data])
    raw = np.full(len(data), np.log((w * y).sum() / (w * (1 - y)).sum()))
    strength = lambda g, h: max(abs(g) - p.l1, 0.0) ** 2 / (h + p.l2)
    trees = []
    for turn in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g = np.rint((prob - y) * w * lw.SCALE) / lw.SCALE
        h = np.rint(prob * (1 - prob) * w * lw.SCALE) / lw.SCALE
        leaves, depth, splits = {0: np.arange(len(data))}, {0: 0}, []
        while len(leaves) < p.leaves:
            found = []
            for leaf, own in leaves.items():
                if 0 < p.depth <= depth[leaf]:
                    continue
                for f in columns_of(turn):
                    for b in range(255):
                        left, right = own[cells[own, f] <= b], own[cells[own, f] > b]
                        if len(left) >= p.min_rows and len(right) >= p.min_rows and min(h[left].sum(), h[right].sum()) >= p.min_hessian:
                            gain = sum(strength(g[x].sum(), h[x].sum()) for x in (left, right)) - strength(g[own].sum(), h[own].sum())
                            found.append((-round(gain, 9), leaf, f, b))
            if not found or min(found)[0] >= 0:
                break
            gain, leaf, f, b = min(found)
            own = leaves[leaf]
            depth[len(leaves)] = depth[leaf] = depth[leaf] + 1
            leaves[len(leaves)] = own[cells[own, f] > b]
            leaves[leaf] = own[cells[own, f] <= b]
            splits.append((f, -gain))
        for own in leaves.values():
            total = g[own].sum()
            raw[own] += -np.sign(total) * max(abs(total) - p.l1, 0.0) / (h[own].sum() + p.l2) * p.rate
        trees.append(splits)
    return trees, raw


@pytest.mark.parametrize("change", [{}, {"leaves": 4}, {"depth": 2}, {"l1": 0.0, "l2": 3.0, "min_rows": 60}])
def test_trees_equal_those_grown_leaf_by_leaf(spark, rows, change):
    p = replace(lw.LeafwiseParams(rounds=3, leaves=9, min_rows=25, bins=20, column_share=1.0, row_share=1.0), **change)
    data = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["id"])
    want, raw = plain_trees(data, p, 3, lambda turn: range(3))
    model = lw.train_leafwise(rows, FEATURES, "y", p, "w")
    got = [[(int(f), round(float(g), 6)) for f, g in zip(t.feature, t.gain)] for t in model.trees]
    assert got == [[(f, round(g, 6)) for f, g in tree] for tree in want]
    scored = {r.id: r.raw for r in tr.raw_scores(model, rows).select("id", "raw").collect()}
    assert np.allclose([scored[r["id"]] for r in data], raw)


def test_one_scan_holds_few_or_many_leaves(spark, rows, monkeypatch):
    """How many leaves a scan looks at, and when scores are written, changes no tree."""
    p = lw.LeafwiseParams(rounds=4, leaves=12, min_rows=20, column_share=0.7, row_share=0.8)
    many = lw.train_leafwise(rows, FEATURES, "y", p)
    monkeypatch.setattr(lw, "MOST_NODES", 1)
    monkeypatch.setattr(lw, "REFRESH", 2)
    few = lw.train_leafwise(rows.repartition(3), FEATURES, "y", p)
    assert tr.to_text(many) == tr.to_text(few)
    assert all(t.count[0] < 1500 * 0.9 for t in many.trees)  # a share of the rows
    assert len({tuple(sorted({*t.feature.tolist()})) for t in many.trees}) > 1  # and of the features


def test_search_equals_single_trainings(spark, rows):
    space = {"rate": [0.05, 0.3], "leaves": [3, 8], "l1": [0.0, 0.5]}
    found = lw.search_leafwise(rows, FEATURES, "y", "w", "fold", 3, 4, 5, 2, {**space, "min_rows": [30]})
    assert len(found.points) == 4 and found.losses[found.best] == min(found.losses)
    most = 0
    for point, loss in zip(found.points, found.losses):
        own = []
        for fold in range(3):
            p = replace(lw.LeafwiseParams(rounds=2, seed=5), **point)
            alone = lw.grow(rows, FEATURES, [(p, fold)], "y", "w", "fold")
            most = max(most, alone.scans)
            model = lw.as_model(alone.models[0], FEATURES, alone.uppers)
            inside = tr.score_trees(model, rows.where(F.col("fold") == fold), "p")
            wrong = -F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
            own.append(inside.agg((F.sum(F.col("w") * wrong) / F.sum("w")).alias("loss")).first().loss)
        assert abs(np.mean(own) - loss) < 1e-9
    assert found.scans <= 2 * most
    refit = lw.train_leafwise(rows, FEATURES, "y", replace(lw.LeafwiseParams(rounds=2, seed=5), **found.points[found.best]), "w")
    assert tr.to_text(refit) == tr.to_text(found.model)


def test_the_grid_has_all_published_points():
    points = lw.search_points(10_000, 1)
    assert len(points) == len({tuple(p.items()) for p in points}) == 576
    assert lw.search_points(5, 7) == lw.search_points(5, 7) != lw.search_points(5, 8)


def test_edges(spark, rows):
    """One class, one row, no rows, equal values, missing values everywhere, too many models."""
    p = lw.LeafwiseParams(rounds=2, min_rows=1)
    for part in (rows.where("y = 1"), rows.limit(1), rows.limit(0), rows.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double"))):
        model = lw.train_leafwise(part, ["a", "b"], "y", replace(p, min_rows=400))
        assert len(model.trees) == 2 and part.count() == tr.score_trees(model, part).where("y_prob BETWEEN 0 AND 1").count()
        assert tr.to_text(tr.from_text(tr.to_text(model))) == tr.to_text(model)
    with pytest.raises(ValueError):
        lw.grow(rows, ["a"], [(p, -1)] * 129, "y")


def test_cut_points_put_equal_numbers_into_bins(spark):
    values = [(float(i * i % 1009),) for i in range(5000)] + [(-1.0,)] * 3000 + [(None,)]
    frame = spark.createDataFrame(values, "v double").repartition(7)
    (uppers,) = lw.cut_points(frame, ["v"], 30)
    cells, count = bins_of([v for (v,) in values], 30)
    assert len(uppers) == count and (lw._bins_of(np.array([np.nan if v is None else v for (v,) in values]), uppers) == cells).all()


def test_file_round_trip(spark, rows, tmp_path):
    model = lw.train_leafwise(rows, FEATURES, "y", lw.LeafwiseParams(rounds=3, min_rows=30))
    writers.write_model_text(spark, model, str(tmp_path / "model.txt"))
    again = tables.read_model_text(spark, str(tmp_path / "model.txt"))
    both = tr.raw_scores(again, tr.raw_scores(model, rows), "again")
    assert both.where("raw <> again").count() == 0 and again.features == FEATURES
    table = tr.split_importance(spark, again).collect()
    assert sum(r.splits for r in table) == sum(len(t.feature) for t in model.trees)
    text = (tmp_path / "model.txt").read_text()
    sizes = [int(x) for x in text.split("tree_sizes=")[1].splitlines()[0].split()]
    assert sum(sizes) == len(text.split("\n\n", 1)[1].split("end of trees")[0])


def test_other_models_are_refused():
    text = tr.to_text(tr.TreeModel(["a"], []))
    with pytest.raises(ValueError):
        tr.from_text(text.replace("num_tree_per_iteration=1", "num_tree_per_iteration=3"))
    leaf = "\nTree=0\nnum_leaves=1\nnum_cat=1\nleaf_value=0.5\nleaf_count=1\nis_linear=0\nshrinkage=1\n\nend of trees"
    with pytest.raises(ValueError):
        tr.from_text(text.replace("end of trees", leaf))
    only = tr.from_text(text.replace("end of trees", leaf.replace("num_cat=1", "num_cat=0")))
    assert only.trees[0].value.tolist() == [0.5] and only.trees[0].depth() == 0


def test_a_search_bins_rows_once_into_blocks(spark, rows, monkeypatch):
    """The search, its refit and a training on its data share one binned table, whose rows are blocks of rows."""
    calls, cut = [], lw.cut_points
    monkeypatch.setattr(lw, "cut_points", lambda *a: calls.append(a) or cut(*a))
    monkeypatch.setattr(lw, "BLOCK_ROWS", 100)
    found = lw.search_leafwise(rows, FEATURES, "y", "w", "fold", 3, 2, 5, 1, {"leaves": [2, 3], "min_rows": [30]})
    lw.grow(rows, FEATURES, [(lw.LeafwiseParams(rounds=1, leaves=2), 0)], "y", "w", "fold", data=found.data)
    sizes = [r.size for r in found.data.state.select("size").collect()]
    assert len(calls) == 1 and sum(sizes) == rows.count() and max(sizes) <= 100 and len(sizes) < rows.count() / 10


def test_scores_of_rows_that_leave_early(spark):
    """A chain of splits: most rows end at its top; missing values go each node's way; a tree may be one leaf."""
    n = 40
    steps = np.arange(n)
    right = np.where(steps < n - 1, steps + 1, ~n)
    kind = np.full(n, tr.DEFAULT_LEFT | tr.NAN_MISSING << tr.MISSING_SHIFT)
    kind[0] = tr.NAN_MISSING << tr.MISSING_SHIFT
    chain = tr.Tree(steps * 0, steps + 0.5, ~steps, right, kind, steps * 1.0, steps, np.arange(n + 1.0), np.arange(n + 1))
    none = np.zeros(0, np.int64)
    leaf = tr.Tree(none, none * 1.0, none, none, none, none * 1.0, none, np.array([0.25]), np.array([1]))
    data = spark.createDataFrame([(float(i),) for i in range(60)] + [(None,), (float("nan"),)], "a double")
    plan = tr.raw_scores(tr.TreeModel(["a"], [chain, leaf]), data)
    got = {repr(r.a): r.raw for r in plan.collect()}
    assert all(got[repr(float(i))] == min(i, n) + 0.25 for i in range(60))
    assert got["None"] == got["nan"] == 1.25
