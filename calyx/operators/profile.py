"""Profiling aggregates (C1-C8, C14).  Each is one or two aggregation passes;
results are small long-form tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.operators.ranking import exact_quantiles


def _stack(cols: Sequence[str], value_name: str = "value", key_name: str = "column") -> F.Column:
    """Generator turning one wide row into (key, value) rows: no join, no second scan."""
    return F.explode(F.array(*[F.struct(F.lit(c).alias(key_name), F.col(c).cast("double").alias(value_name))
                               for c in cols]))


def table_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, n_missing) in one pass over all columns."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"))
                                           for c in cols])).alias("s")).select("s.*")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the per-class table (one row per class), not the data
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c): (label, n, weight)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    all_classes = Window.partitionBy()  # over the per-class table only
    return counts.select(label, "n", (F.sum("n").over(all_classes)
                                      / (F.count(F.lit(1)).over(all_classes) * F.col("n"))).alias("weight"))


def attach_weights(df: DataFrame, label: str = "label", weight_col: str = "weight",
                   counted: F.Column | None = None) -> DataFrame:
    """Add the balanced class weight per row; the weights table has one row per class.
    `counted`: only these rows (the train part) set the weights; classes they lack get NULL."""
    w = class_weights(df if counted is None else df.where(counted), label).select(label, F.col("weight").alias(weight_col))
    return df.join(w, label, "left")  # AQE broadcasts it once its size is known


def describe_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per column."""
    long = df.select(_stack(cols).alias("s")).select("s.column", "s.value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], names=["p25", "p50", "p75"]).drop("n")
    return basic.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows repeating an earlier row: sum over groups of (n - 1)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum(F.col("_n") - 1).cast("bigint").alias("n_duplicates"),
                 F.count(F.lit(1)).alias("n_distinct"))


def boxplot_stats(df: DataFrame, features: Sequence[str], label: str = "label", whis: float = 1.5) -> DataFrame:
    """Per (feature, class): quartiles, whisker ends (extreme data within
    whis*IQR of the box), outlier count."""
    long = df.select(label, _stack(features, key_name="feature").alias("s")).select(label, "s.feature", "s.value")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature", label], names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("feature", label, "n", "q1", "median", "q3",
                      (F.col("q1") - whis * iqr).alias("_lo"), (F.col("q3") + whis * iqr).alias("_hi"))
    # one fence row per (feature, class); AQE broadcasts it once its size is known
    j = long.where(F.col("value").isNotNull()).join(fences, ["feature", label])
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    return j.groupBy("feature", label, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum((~inside).cast("bigint")).alias("n_outliers"))


def count_by_feature_class(df: DataFrame, features: Sequence[str], label: str = "label",
                           max_levels: int = 5) -> DataFrame:
    """(feature, value, label, n) for features with at most `max_levels` distinct values."""
    nd = df.agg(*[F.count_distinct(c).alias(c) for c in features]).first()
    low = [c for c in features if nd[c] <= max_levels]
    if not low:
        return df.sparkSession.createDataFrame([], "feature string, value double, label int, n bigint")
    long = df.select(label, _stack(low, key_name="feature").alias("s")).select(label, "s.feature", "s.value")
    return long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))


# exp(-z*z/2) is exactly 0.0 in double precision once |z| > 38.6 (below the
# smallest subnormal), so grid points farther than this many bandwidths from
# a value receive nothing from it.
KDE_CUTOFF = 39.0


def kde_by_class(df: DataFrame, feature: str, label: str = "label", grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE per class, each normalised alone; Scott bandwidth
    h = std(ddof 1) * n^(-1/5); grid of `grid` points from min-cut*h to max+cut*h.

    Work: each distinct (class, value) row emits only the grid points within
    KDE_CUTOFF bandwidths (all others add exactly 0.0), so the cost per value
    shrinks as n grows and h narrows; the sums are bit-for-bit the full ones.
    """
    x = F.col(feature)
    vals = df.where(x.isNotNull()).groupBy(label, feature).agg(F.count(F.lit(1)).alias("_w"))
    stats = df.where(x.isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(feature).alias("_sd"),
        F.min(feature).alias("_mn"), F.max(feature).alias("_mx"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), -0.2))
    # a class with one distinct value has no bandwidth: no density, as the plotting library skips it
    stats = stats.where(F.col("_h") > 0)
    stats = stats.withColumn("_lo", F.col("_mn") - cut * F.col("_h")).withColumn(
        "_step", (F.col("_mx") + cut * F.col("_h") - F.col("_lo")) / (grid - 1))
    j = vals.join(stats, label)  # one stats row per class; AQE broadcasts it once its size is known
    reach = F.lit(KDE_CUTOFF) * F.col("_h")
    first = F.greatest(F.ceil((x - reach - F.col("_lo")) / F.col("_step")), F.lit(0)).cast("int")
    last = F.least(F.floor((x + reach - F.col("_lo")) / F.col("_step")), F.lit(grid - 1)).cast("int")
    pts = j.where(first <= last).select(label, "_w", "_n", "_h", "_lo", "_step", x.alias("_x"),
                                        F.explode(F.sequence(first, last)).alias("grid_index"))
    g = F.col("_lo") + F.col("grid_index") * F.col("_step")
    z = (g - F.col("_x")) / F.col("_h")
    kern = F.col("_w") * F.exp(-0.5 * z * z)
    norm = 1.0 / math.sqrt(2 * math.pi)
    grid_rows = stats.select(label, "_n", "_h", "_lo", "_step",
                             F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_index"))
    sums = pts.groupBy(label, "grid_index").agg(F.sum(kern).alias("_s"))
    full = grid_rows.join(sums, [label, "grid_index"], "left").fillna(0.0, ["_s"])  # classes x grid rows
    return full.select(label, "grid_index", (F.col("_lo") + F.col("grid_index") * F.col("_step")).alias("x"),
                       (F.col("_s") * norm / (F.col("_n") * F.col("_h"))).alias("density"))
