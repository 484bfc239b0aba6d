"""One fit for many tree models.

A tree of depth d is the top of a deeper tree grown with the same other settings,
and the first t trees of a forest are a forest of t trees.  So one deep fit is
scored at every depth, one large forest at every number of trees.

Spark folds two leaves of equal class into their parent when a fit ends; a cut
tree is folded in the same way, so its scores are those of a separate fit.  What a
class counts at a node is the sum over the leaves below it: of training rows for
one tree, of the saved node statistics for the trees of a forest, whose rows are
drawn anew for each tree.

Rows stay distributed: a model says which leaf a row falls in, and rows are counted
by (leaf, label).  Driver tables have one row for each node, as the model itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.operators.explain import scratch_path


class Tree:
    """A fitted tree: children of each node in preorder (-1: none), and its leaves from left to right."""

    def __init__(self, left: Sequence[int], right: Sequence[int]):
        self.left, self.right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.leaves = np.flatnonzero(self.left < 0)

    @classmethod
    def of(cls, model) -> Tree:
        """From a model's description, whose lines are its nodes in preorder."""
        kinds = [line.strip().split(" ")[0] for line in model.toDebugString.splitlines()[1:] if line.strip()]
        left, right, at = [], [], 0

        def node() -> int:
            nonlocal at
            me = len(left)
            left.append(-1)
            right.append(-1)
            kind, at = kinds[at], at + 1
            if kind == "If":
                left[me] = node()
                at += 1  # the Else before the right child
                right[me] = node()
            return me

        node()
        return cls(left, right)

    def class_sums(self, leaf_sums: np.ndarray) -> np.ndarray:
        """Class sums of every node, from those of the leaves (leaves x classes)."""
        out = np.zeros((len(self.left), leaf_sums.shape[1]))
        out[self.leaves] = leaf_sums
        for i in range(len(self.left) - 1, -1, -1):  # children come after their parent
            if self.left[i] >= 0:
                out[i] = out[self.left[i]] + out[self.right[i]]
        return out

    def cut(self, depth: int | None, classes: np.ndarray) -> np.ndarray:
        """For each leaf, the node that stands for it in the tree of that depth; classes: the class of every node."""
        stands = np.empty(len(self.left), np.int64)

        def settle(node: int, left_over: int) -> tuple[list[int], bool]:
            """Leaves under a node, and whether it is a leaf of the cut tree."""
            if self.left[node] < 0:
                stands[node] = node
                return [node], True
            sides = [settle(child, left_over - 1) for child in (self.left[node], self.right[node])]
            under = sides[0][0] + sides[1][0]
            alike = classes[self.left[node]] == classes[self.right[node]]
            if left_over <= 0 or (sides[0][1] and sides[1][1] and alike):
                stands[under] = node
                return under, True
            return under, False

        settle(0, len(self.left) if depth is None else depth)
        return stands[self.leaves]


def _leaf_table(model, df: DataFrame, by: Sequence[str], label: str, weight: str | None) -> pd.DataFrame:
    """(by, leaf, label, n, w): rows and their weights, counted by leaf."""
    placed = model.copy().setLeafCol("_leaf").transform(df)
    w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return placed.groupBy(*by, F.col("_leaf").cast("int").alias("leaf"), F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), w.alias("w")).toPandas()  # one row for each leaf, class and part


def depth_confusions(model, parts: DataFrame, depths: Iterable[int | None], label: str = "label", weight: str | None = None,
                     part: str = "part", fitted: str = "train") -> list[dict]:
    """One dict (max_depth, part, tp, fp, fn, tn) for each depth and part.

    model: a decision tree classifier fitted on the rows of `parts` whose `part` is
    `fitted`, as deep as the deepest of `depths` (None: as it is).
    """
    tree = Tree.of(model)
    table = _leaf_table(model, parts, [part], label, weight)
    sums = np.zeros((len(tree.leaves), 2))
    train = table[table[part] == fitted]
    np.add.at(sums, (train.leaf.to_numpy(), train.label.to_numpy()), train.w.to_numpy())
    classes = tree.class_sums(sums).argmax(axis=1)
    out = []
    for depth in depths:
        said = classes[tree.cut(depth, classes)]
        for name, rows in table.groupby(part):
            got, n, y = said[rows.leaf.to_numpy()], rows.n.to_numpy(), rows.label.to_numpy()
            out.append({"max_depth": depth, "part": name, "tp": int(n[(got == 1) & (y == 1)].sum()), "fp": int(n[(got == 1) & (y == 0)].sum()),
                        "fn": int(n[(got == 0) & (y == 1)].sum()), "tn": int(n[(got == 0) & (y == 0)].sum())})
    return out


def depth_scores(model, train: DataFrame, df: DataFrame, depths: Sequence[int | None], keep: Sequence[str] = ("id", "label"),
                 label: str = "label", weight: str | None = None) -> DataFrame:
    """(keep, max_depth, score): the class-1 probability of each row under the tree of each depth."""
    tree = Tree.of(model)
    table = _leaf_table(model, train, [], label, weight)
    leaf_sums = np.zeros((len(tree.leaves), 2))
    np.add.at(leaf_sums, (table.leaf.to_numpy(), table.label.to_numpy()), table.w.to_numpy())
    sums = tree.class_sums(leaf_sums)
    classes = sums.argmax(axis=1)
    rows = []
    for depth in depths:
        at = tree.cut(depth, classes)
        rows += [(leaf, depth, float(s)) for leaf, s in enumerate(sums[at, 1] / sums[at].sum(axis=1))]
    scores = df.sparkSession.createDataFrame(rows, "_leaf int, max_depth int, score double")
    placed = model.copy().setLeafCol("_leaf").transform(df).select(*keep, F.col("_leaf").cast("int").alias("_leaf"))
    return placed.join(scores, "_leaf").drop("_leaf")


# ---- forests -------------------------------------------------------------------

def forest_trees(model, spark) -> list[tuple[Tree, np.ndarray]]:
    """Every tree of a saved forest, with the class sums of its nodes."""
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats").toPandas()
    out = []
    for _, each in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        out.append((Tree(each.leftChild.to_numpy(), each.rightChild.to_numpy()), np.stack(each.impurityStats.to_numpy())))
    return out


def forest_scores(model, df: DataFrame, variants: Sequence[tuple[int, int | None]], keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """`keep` and `scores`: for each (number of trees, depth) the class-1 probability of the forest's first trees, cut at that depth."""
    trees = forest_trees(model, df.sparkSession)
    depths = sorted({d for _, d in variants}, key=lambda d: (d is None, d or 0))
    tables = []
    for depth in depths:
        each = []
        for tree, sums in trees:
            at = tree.cut(depth, sums.argmax(axis=1))
            total = sums[at].sum(axis=1)
            each.append(np.divide(sums[at, 1], total, out=np.zeros(len(at)), where=total > 0))
        size = max(map(len, each))
        tables.append(np.stack([np.pad(e, (0, size - len(e))) for e in each]))
    wanted = [(t, depths.index(d)) for t, d in variants]

    @F.pandas_udf("array<double>")
    def scored(leaves: pd.Series) -> pd.Series:
        if not len(leaves):
            return pd.Series([], dtype=object)
        at = np.stack(leaves.to_numpy()).astype(np.int64)
        sums = [np.cumsum(table[np.arange(at.shape[1]), at], axis=1) for table in tables]
        return pd.Series(list(np.stack([sums[d][:, t - 1] / t for t, d in wanted], axis=1)))

    placed = model.copy().setLeafCol("_leaf").transform(df)
    return placed.select(*keep, scored(vector_to_array("_leaf")).alias("scores"))


def forest_confusions(model, parts: DataFrame, variants: Sequence[tuple[int, int | None]], label: str = "label", part: str = "part") -> list[dict]:
    """One dict (n_trees, max_depth, part, tp, fp, fn, tn) for each variant and part; class 1 where it has most of the vote."""
    scores = forest_scores(model, parts, variants, [part, label]).select(part, label, F.posexplode("scores").alias("variant", "score"))
    said, y = F.col("score") > 0.5, F.col(label) == 1
    cells = {"tp": said & y, "fp": said & ~y, "fn": ~said & y, "tn": ~said & ~y}
    rows = scores.groupBy(part, "variant").agg(*[F.count_if(c).alias(k) for k, c in cells.items()]).collect()  # parts x variants rows
    return [{"n_trees": variants[r["variant"]][0], "max_depth": variants[r["variant"]][1], "part": r[part], **{k: r[k] for k in cells}} for r in rows]


def f1(cells: dict) -> float:
    wrong = cells["fp"] + cells["fn"]
    return 2 * cells["tp"] / (2 * cells["tp"] + wrong) if cells["tp"] + wrong else 0.0


def accuracy(cells: dict) -> float:
    return (cells["tp"] + cells["tn"]) / (cells["tp"] + cells["fp"] + cells["fn"] + cells["tn"])
