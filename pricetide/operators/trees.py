"""Tree models as node tables: scores of Arrow batches, the public text format, importances."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Bits of a node's decision type in the text format.
CATEGORY, DEFAULT_LEFT, MISSING_SHIFT = 1, 2, 2
NO_MISSING, ZERO_MISSING, NAN_MISSING = 0, 1, 2
#: Values up to this size count as zero where zero means missing.
ZERO = 1e-35


@dataclass
class Tree:
    """Inner nodes as arrays, the root first; children below zero are leaves: -1 is leaf 0, -2 leaf 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    kind: np.ndarray  # decision types
    gain: np.ndarray
    count: np.ndarray
    value: np.ndarray  # of leaves, shrunk
    leaf_count: np.ndarray
    shrinkage: float = 1.0

    def depth(self) -> int:
        deepest, at = 0, [(0, 1)] if len(self.feature) else []
        while at:
            node, depth = at.pop()
            deepest = max(deepest, depth)
            at += [(int(child), depth + 1) for child in (self.left[node], self.right[node]) if child >= 0]
        return deepest


@dataclass
class TreeModel:
    """A sum of trees over named features; with `sigmoid` (its factor) the sum is a log odds, else a value."""

    features: list[str]
    trees: list[Tree]
    sigmoid: float | None = 1.0
    infos: list[str] | None = None  # range of each feature, as the text format has it


def node_table(spark: SparkSession, model: TreeModel) -> DataFrame:
    """One row per node: tree, node (below zero: leaf), feature, threshold, children, gain, count, value."""
    rows = []
    for k, t in enumerate(model.trees):
        for i in range(len(t.feature)):
            split = (model.features[t.feature[i]], float(t.threshold[i]), int(t.left[i]), int(t.right[i]), float(t.gain[i]))
            rows.append((k, i, *split, int(t.count[i]), None))
        rows += [(k, ~i, *(None,) * 5, int(t.leaf_count[i]), float(v)) for i, v in enumerate(t.value)]
    return spark.createDataFrame(
        rows, "tree int, node int, feature string, threshold double, left int, right int, gain double, count long, value double"
    )


def _leaves(tree: Tree, values: np.ndarray) -> np.ndarray:
    """Number of the leaf that each row of `values` reaches; a row is looked at no longer than it is on its way."""
    found = np.zeros(len(values), np.int64)
    if not len(tree.feature):
        return found
    default, missing = (tree.kind & DEFAULT_LEFT) != 0, tree.kind >> MISSING_SHIFT & 3
    moving, node = np.arange(len(values)), np.zeros(len(values), np.int64)
    while len(moving):
        raw = values[moving, tree.feature[node]]
        blank = np.isnan(raw)
        value = np.where(blank, 0.0, raw)
        by_default = ((missing[node] == NAN_MISSING) & blank) | ((missing[node] == ZERO_MISSING) & (np.abs(value) <= ZERO))
        node = np.where(np.where(by_default, default[node], value <= tree.threshold[node]), tree.left[node], tree.right[node])
        inside = node >= 0
        found[moving[~inside]] = -1 - node[~inside]
        moving, node = moving[inside], node[inside]
    return found


def raw_scores(model: TreeModel, rows: DataFrame, name: str = "raw") -> DataFrame:
    """Add the sum of the leaf values that each row reaches.

    The model travels with the code, bounded by its trees and leaves; the plan's size does not depend on it. NULL and
    NaN take the way that the node's decision type names.
    """
    trees = model.trees

    def total(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(float) for c in columns], axis=1)
        sums = np.zeros(len(values))
        for tree in trees:
            sums += tree.value[_leaves(tree, values)]
        return pd.Series(sums)

    features = [F.col(f"`{feature}`").cast("double") for feature in model.features]
    return rows.withColumn(name, F.pandas_udf(total, "double")(*(features or [F.lit(0.0)])))


def score_trees(model: TreeModel, rows: DataFrame, name: str = "y_prob") -> DataFrame:
    """Add the probability of class 1, or the value of a model without classes."""
    scored = raw_scores(model, rows, name)
    return scored if model.sigmoid is None else scored.withColumn(name, 1 / (1 + F.exp(-F.lit(model.sigmoid) * F.col(name))))


def split_importance(spark: SparkSession, model: TreeModel) -> DataFrame:
    """Splits and total gain of every feature, as a table."""
    splits, gains = np.zeros(len(model.features), np.int64), np.zeros(len(model.features))
    for t in model.trees:
        np.add.at(splits, t.feature, 1)
        np.add.at(gains, t.feature, t.gain)
    rows = [(f, int(n), float(g)) for f, n, g in zip(model.features, splits, gains)]
    return spark.createDataFrame(rows, "feature string, splits long, gain double")


def _line(name: str, values) -> str:
    return f"{name}=" + " ".join(repr(float(v)) if isinstance(v, float) else str(v) for v in values)


def to_text(model: TreeModel) -> str:
    """The model in the public text format of LightGBM."""
    blocks = []
    for k, t in enumerate(model.trees):
        lines = [f"Tree={k}", f"num_leaves={len(t.value)}", "num_cat=0"]
        columns = {"split_feature": t.feature, "split_gain": t.gain, "threshold": t.threshold, "decision_type": t.kind}
        columns |= {"left_child": t.left, "right_child": t.right}
        if len(t.feature):
            lines += [_line(name, values.tolist()) for name, values in columns.items()]
        lines += [_line("leaf_value", t.value.tolist()), _line("leaf_count", t.leaf_count.tolist())]
        if len(t.feature):
            lines.append(_line("internal_count", t.count.tolist()))
        blocks.append("\n".join([*lines, "is_linear=0", f"shrinkage={t.shrinkage!r}", "", "", ""]))
    objective = "regression" if model.sigmoid is None else f"binary sigmoid:{model.sigmoid:g}"
    infos = model.infos or ["[-inf:inf]"] * len(model.features)
    if any(" " in feature for feature in model.features):
        raise ValueError("names with spaces do not fit into the text format")
    head = [
        "tree", "version=v4", "num_class=1", "num_tree_per_iteration=1", "label_index=0",
        f"max_feature_idx={len(model.features) - 1}", f"objective={objective}", _line("feature_names", model.features),
        _line("feature_infos", infos), _line("tree_sizes", [len(block.encode()) for block in blocks]), "", "",
    ]
    return "\n".join(head) + "".join(blocks) + "end of trees\n\nfeature_importances:\n\nparameters:\nend of parameters\n\npandas_categorical:null\n"


def from_text(text: str) -> TreeModel:
    """A model of one output from the public text format; trees with categories or linear leaves are refused."""
    head, *blocks = text.split("\nTree=")
    known = dict(line.split("=", 1) for line in head.splitlines() if "=" in line)
    if int(known.get("num_tree_per_iteration", 1)) != 1:
        raise ValueError("models with several outputs are not read")
    objective = known.get("objective", "").split()
    sigmoid = next((float(part.split(":")[1]) for part in objective if part.startswith("sigmoid:")), 1.0)
    trees = []
    for block in blocks:
        own = dict(line.split("=", 1) for line in block.split("end of trees")[0].splitlines()[1:] if "=" in line)
        if int(own.get("num_cat", 0)) or int(own.get("is_linear", 0)):
            raise ValueError("categories and linear leaves are not read")
        inner, leaves = int(own["num_leaves"]) - 1, int(own["num_leaves"])
        column = lambda name, kind, size: np.array((own.get(name) or " ".join(["0"] * size)).split(), float).astype(kind)
        trees.append(
            Tree(
                *(column(name, np.int64 if name != "threshold" else float, inner) for name in ("split_feature", "threshold", "left_child", "right_child")),
                column("decision_type", np.int64, inner),
                column("split_gain", float, inner),
                column("internal_count", np.int64, inner),
                column("leaf_value", float, leaves),
                column("leaf_count", np.int64, leaves),
                float(own.get("shrinkage", 1)),
            )
        )
        if (trees[-1].kind & CATEGORY).any() or len(trees[-1].feature) != inner or len(trees[-1].value) != leaves:
            raise ValueError("a tree's arrays do not fit its number of leaves")
    return TreeModel(
        known["feature_names"].split(), trees, sigmoid if objective[:1] in (["binary"], ["cross_entropy"]) else None,
        known["feature_infos"].split() if "feature_infos" in known else None,
    )
