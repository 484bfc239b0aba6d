"""Model explanation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions.exprs import apply_threshold
from calyx.functions.hashing import uniform
from calyx.operators import evaluate as E
from calyx.operators.ranking import choose_buckets, rank_by_value, rank_in_groups, uniform_bucket
from calyx.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "calyx", f"{name}-{uuid.uuid4().hex[:12]}")


def coefficients(spark: SparkSession, lr_model, names: Sequence[str], top: int = 15) -> DataFrame:
    """(feature, coefficient, abs_coefficient), the `top` largest by absolute value."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, lr_model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    return df.orderBy(F.col("abs_coefficient").desc(), "feature").limit(top)


def tree_importance(spark: SparkSession, tree_model, names: Sequence[str], top: int = 10) -> DataFrame:
    """(feature, importance): impurity importance normalised to 1, the `top` largest."""
    imp = tree_model.featureImportances.toArray()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(top)


def tree_nodes(spark: SparkSession, tree_model, names: Sequence[str]) -> DataFrame:
    """Node table of a fitted tree read from its saved node data:
    (node_id, depth, feature, threshold, impurity, n, prediction, left, right)."""
    path = scratch_path(spark, "tree")
    tree_model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    name_map = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    nodes = data.select(
        F.col("id").alias("node_id"), F.col("prediction"), F.col("impurity"),
        F.col("rawCount").alias("n"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(F.col("leftChild") >= 0, name_map[F.col("split.featureIndex")]).alias("feature"),
        F.when(F.col("leftChild") >= 0, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"))
    # depth from the preorder ids: a node's depth is its parent's + 1 (tree height <= 30)
    rows = nodes.collect()  # one row per node; bounded by 2^(maxDepth+1)
    parent = {}
    for r in rows:
        for ch in (r["left"], r["right"]):
            if ch is not None and ch >= 0:
                parent[ch] = r["node_id"]
    depth = {}

    def d(i):
        if i not in depth:
            depth[i] = 0 if i not in parent else d(parent[i]) + 1
        return depth[i]

    dep = spark.createDataFrame([(r["node_id"], d(r["node_id"])) for r in rows], "node_id int, depth int")
    return nodes.join(dep, "node_id").select("node_id", "depth", "feature", "threshold", "impurity", "n",
                                             "prediction", "left", "right")


def permuted_rows(df: DataFrame, features: Sequence[str], id_col: str = "id", n_repeats: int = 10,
                  seed: int = 42) -> DataFrame:
    """rows x (feature, repeat) with that one feature shuffled.

    The row at id-rank i receives the feature value of the row at rank i of
    u(seed|feature|repeat|id): a fresh permutation per (feature, repeat),
    applied by an equi-join on rank.  Rows fan out through a generator;
    output adds `_feat`, `_rep`.
    """
    n = df.count()
    b = choose_buckets(n)
    base = rank_by_value(df, [], id_col, n_buckets=b, rank_col="_pos")
    keys = F.array(*[F.struct(F.lit(f).alias("_feat"), F.lit(r).alias("_rep"))
                     for f in features for r in range(n_repeats)])
    ex = base.select("*", F.explode(keys).alias("_k")).select("*", "_k._feat", "_k._rep").drop("_k")
    donors = ex.withColumn("_u", uniform(F.col("_feat"), F.col("_rep"), F.col(id_col), seed=seed))
    donors = rank_in_groups(donors, ["_feat", "_rep"], ["_u", id_col], uniform_bucket("_u", b), "_dpos")
    donor_vals = donors.select("_feat", "_rep", F.col("_dpos").alias("_pos"),
                               F.map_from_arrays(F.array(*[F.lit(f) for f in features]),
                                                 F.array(*[F.col(f).cast("double") for f in features])).alias("_dv"))
    j = ex.join(donor_vals, ["_feat", "_rep", "_pos"])
    return j.select(*[F.when(F.col("_feat") == f, F.col("_dv")[f]).otherwise(F.col(f).cast("double")).alias(f)
                      if f in features else F.col(f) for f in df.columns], "_feat", "_rep")


def _f1_drop(base_scored: DataFrame, perm_scored: DataFrame, label: str) -> DataFrame:
    """Mean and population std over repeats of (base F1 - permuted F1) per feature;
    inputs carry a 0/1 `pred` column."""
    base_f1 = E.with_basic_metrics(E.confusion(base_scored, label=label, pred="pred")).first()["f1"]
    per = E.with_basic_metrics(E.confusion(perm_scored, group_cols=["_feat", "_rep"], label=label, pred="pred"))
    per = per.select("_feat", "_rep", (F.lit(base_f1) - F.col("f1")).alias("drop"))
    return per.groupBy(F.col("_feat").alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def permutation_importance(model, df: DataFrame, features: Sequence[str], id_col: str = "id",
                           label: str = "label", n_repeats: int = 10, seed: int = 42,
                           threshold: float = 0.5) -> DataFrame:
    """Mean and std (ddof 0) drop of class-1 F1 when one feature is shuffled,
    over n_repeats shuffles; one `transform` scores every (feature, repeat)."""
    def scored(d):
        s = d.withColumn("score", vector_to_array("probability")[1])
        return s.withColumn("pred", apply_threshold("score", threshold))

    perm = permuted_rows(df, features, id_col, n_repeats, seed)
    return _f1_drop(scored(model.transform(df)), scored(model.transform(perm)), label)


def permutation_importance_expr(df: DataFrame, features: Sequence[str], decision, id_col: str = "id",
                                label: str = "label", n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """Same, for a scorer given as a column expression: `decision()` returns the 0/1 class."""
    perm = permuted_rows(df, features, id_col, n_repeats, seed)
    return _f1_drop(df.withColumn("pred", decision()), perm.withColumn("pred", decision()), label)


def margin_rows(scored: DataFrame, label: str = "label", margin: str = "margin") -> DataFrame:
    """Decision value per row and whether it lies on or inside the margin
    (y * f(x) <= 1 with y in {-1, +1}): the rows that carry a linear SVM."""
    y = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    return scored.withColumn("in_margin", y * F.col(margin) <= 1.0)


def decision_grid(spark: SparkSession, bounds: dict, coef: Sequence[float], intercept: float,
                  steps: int = 300, pad: float = 1.0, names=("x", "y")) -> DataFrame:
    """Linear decision value on a steps x steps lattice spanning [min-pad, max+pad]
    of two features; the lattice is a distributed range, not a driver list."""
    (x0, x1), (y0, y1) = bounds[names[0]], bounds[names[1]]
    x0, x1, y0, y1 = x0 - pad, x1 + pad, y0 - pad, y1 + pad
    g = spark.range(steps * steps)
    ix, iy = (F.col("id") % steps), F.floor(F.col("id") / steps)
    gx = F.lit(x0) + ix * ((x1 - x0) / (steps - 1))
    gy = F.lit(y0) + iy * ((y1 - y0) / (steps - 1))
    out = g.select(ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), gx.alias(names[0]), gy.alias(names[1]))
    return out.withColumn("decision", F.lit(float(coef[0])) * F.col(names[0]) + F.lit(float(coef[1])) * F.col(names[1])
                          + F.lit(float(intercept)))
