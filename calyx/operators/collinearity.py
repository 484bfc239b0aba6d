"""Correlation and variance-inflation pruning.

All of these need only the p x p correlation matrix, which one aggregation
pass produces (p(p-1)/2 `corr` aggregates).  The VIF loop then runs on that
p x p matrix on the driver - its size is the feature count, not the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIF_R2_CAP = 0.999999  # R^2 at or above this gives an infinite VIF


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(cols, 2))


def corr_values(df: DataFrame, cols: Sequence[str], label: str | None = None) -> dict[tuple[str, str], float]:
    """Pearson correlations of every pair (and of each column with `label`) in one pass."""
    pairs = _pairs(cols) + ([(c, label) for c in cols] if label else [])
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: (row[i] if row[i] is not None else float("nan")) for i, p in enumerate(pairs)}


def corr_matrix(df: DataFrame, cols: Sequence[str], absolute: bool = False) -> DataFrame:
    """Long form (feature_a, feature_b, corr) of the full symmetric matrix, diagonal 1."""
    aggs = [F.corr(a, b) for a, b in _pairs(cols)]
    wide = df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]) if aggs else None
    entries = []
    for i, (a, b) in enumerate(_pairs(cols)):
        v = F.abs(F.col(f"c{i}")) if absolute else F.col(f"c{i}")
        entries += [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), v.alias("corr")),
                    F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), v.alias("corr"))]
    entries += [F.struct(F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"), F.lit(1.0).alias("corr"))
                for c in cols]
    base = wide if wide is not None else df.limit(1)
    return base.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def corr_with_target(df: DataFrame, cols: Sequence[str], label: str = "label", by_abs: bool = False) -> DataFrame:
    """(feature, corr, abs_corr, rank): rank 1 = largest signed (or absolute) correlation."""
    wide = df.agg(*[F.corr(c, label).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
                                           for i, c in enumerate(cols)])).alias("e")).select("e.*")
    long = long.withColumn("abs_corr", F.abs("corr"))
    key = F.col("abs_corr") if by_abs else F.col("corr")
    # p rows: a window with no partition is fine here
    return long.withColumn("rank", F.row_number().over(Window.orderBy(key.desc(), F.col("feature"))))


def drop_high_corr_pair(df: DataFrame, a: str, b: str, label: str = "label", threshold: float = 0.95) -> DataFrame:
    """If |corr(a,b)| > threshold drop the one less correlated (absolute) with the
    target; a tie drops `b`.  One row: (pair_corr, a_target_corr, b_target_corr, dropped)."""
    r = df.agg(F.abs(F.corr(a, b)).alias("pair_corr"), F.abs(F.corr(a, label)).alias("a_target_corr"),
               F.abs(F.corr(b, label)).alias("b_target_corr"))
    dropped = F.when(F.col("pair_corr") > threshold,
                     F.when(F.col("a_target_corr") < F.col("b_target_corr"), F.lit(a)).otherwise(F.lit(b)))
    return r.withColumn("dropped", dropped)


def high_corr_pairs(df: DataFrame, cols: Sequence[str], label: str = "label", threshold: float = 0.8) -> DataFrame:
    """Upper-triangle pairs with |r| >= threshold; keep the more target-relevant,
    drop the other (tie drops the second)."""
    pairs = _pairs(cols)
    aggs = [F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    aggs += [F.abs(F.corr(c, label)).alias(f"t{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    idx = {c: i for i, c in enumerate(cols)}
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("corr"),
                     F.col(f"t{idx[a]}").alias("a_target_corr"), F.col(f"t{idx[b]}").alias("b_target_corr"))
            for i, (a, b) in enumerate(pairs)]
    long = wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    keep_a = F.col("a_target_corr") > F.col("b_target_corr")
    return (long.where(F.abs("corr") >= threshold)
                .withColumn("keep", F.when(keep_a, F.col("feature_a")).otherwise(F.col("feature_b")))
                .withColumn("drop", F.when(keep_a, F.col("feature_b")).otherwise(F.col("feature_a"))))


def correlation_array(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """p x p correlation matrix over rows complete in `cols` (listwise, like a regression)."""
    complete = df.dropna(subset=list(cols))
    vals = corr_values(complete, cols)
    p = len(cols)
    r = np.eye(p)
    for (a, b), v in vals.items():
        i, j = cols.index(a), cols.index(b)
        r[i, j] = r[j, i] = v
    return r


def vif_from_corr(r: np.ndarray) -> np.ndarray:
    """VIF_j = 1 / (1 - R^2_j), R^2 of column j on the others with intercept,
    from the correlation matrix; infinite when R^2 >= VIF_R2_CAP or j is constant."""
    p = r.shape[0]
    out = np.empty(p)
    for j in range(p):
        if np.isnan(r[j, j]) or np.isnan(r[j]).all() or np.isnan(r[j, [k for k in range(p) if k != j]]).all():
            out[j] = np.inf if p > 1 else 1.0
            continue
        if p == 1:
            out[j] = 1.0
            continue
        others = [k for k in range(p) if k != j and not np.isnan(r[k, k]) and not np.isnan(r[k]).any()]
        if not others:
            out[j] = 1.0
            continue
        rxx = r[np.ix_(others, others)]
        rxy = r[others, j]
        beta, *_ = np.linalg.lstsq(rxx, rxy, rcond=None)
        r2 = float(rxy @ beta)
        out[j] = np.inf if r2 >= VIF_R2_CAP else 1.0 / (1.0 - r2)
    return out


def _constant_aware_corr(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    r = correlation_array(df, cols)
    # a constant column has NaN correlations; mark its diagonal NaN too
    for i in range(len(cols)):
        if np.isnan(np.delete(r[i], i)).all() and len(cols) > 1:
            r[i, i] = np.nan
    return r


def vif_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, vif) sorted by vif descending."""
    spark: SparkSession = df.sparkSession
    r = _constant_aware_corr(df, list(cols))
    v = vif_from_corr(r)
    rows = sorted(zip(cols, [float(x) for x in v]), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, vif double")


def vif_filter(df: DataFrame, cols: Sequence[str], threshold: float = 10.0,
               protected: Iterable[str] = ()) -> tuple[list[str], list[dict], list[tuple[str, float]]]:
    """Drop the worst VIF column (the worst unprotected one if the worst is
    protected) until every VIF is <= threshold or only protected ones exceed it.

    One data pass for the correlation matrix; the loop works on sub-matrices.
    Returns (kept, dropped log [(feature, vif)], final table sorted desc).
    """
    cols = list(cols)
    protected = set(protected)
    r_full = _constant_aware_corr(df, cols)
    active = list(range(len(cols)))
    dropped: list[dict] = []
    while active:
        v = vif_from_corr(r_full[np.ix_(active, active)])
        order = sorted(range(len(active)), key=lambda i: -v[i])
        worst = order[0]
        if v[worst] <= threshold:
            break
        pick = worst
        if cols[active[worst]] in protected:
            cands = [i for i in order if cols[active[i]] not in protected]
            if not cands or v[cands[0]] <= threshold:
                break
            pick = cands[0]
        dropped.append({"feature": cols[active[pick]], "vif": round(float(v[pick]), 4)})
        active.pop(pick)
    final = vif_from_corr(r_full[np.ix_(active, active)]) if active else np.array([])
    table = sorted([(cols[a], float(x)) for a, x in zip(active, final)], key=lambda t: -t[1])
    return [cols[a] for a in active], dropped, table
