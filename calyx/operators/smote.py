"""SMOTE: synthetic minority rows x + lam * (nn - x), nn among the k nearest
minority points (D7).

Exact k-nearest neighbours without comparing all pairs:

1. Exact duplicates are merged into distinct points first (a point repeated
   by a third of the rows is one row), each with a representative id.
2. The points are cut into leaves by recursive median splits, each along the
   side on which the leaf is widest; the cuts come from a bounded sample, the
   leaves' boxes from all points.  A leaf with more than BLOCK points is dealt
   out over blocks, so no task holds more than a block and a chunk of visitors.
3. A point is compared with its own leaf, which bounds the distance to its
   k-th neighbour; then with the NEAR nearest leaves within that bound, which
   tightens it; then with all other leaves whose box is within the new bound.
   A leaf that is never visited can't hold a neighbour.

Draws are the portable hash of (seed, sample index): base row uniformly
among the minority rows, neighbour uniformly among its k, lam in [0,1).
So results do not depend on partitioning and match a brute-force oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.functions.hashing import uniform
from calyx.operators.ranking import choose_buckets, rank_by_value
from calyx.operators.sampling import class_sizes
from calyx.session import cut_lineage


#: Points of a block, leaves visited in the second round, points that the cuts are taken from, visitors of a chunk.
BLOCK, NEAR, SAMPLE, CHUNK = 2048, 4, 1 << 14, 4096
#: Visitors compared with a block at once: their distances, and arrays as large to order them, are what a worker holds most of.
SLICE = 256


class MedianSplits:
    """Leaves of recursive median splits of a sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.low, self.high, self.leaf = [], [], [], [], []
        self.n_leaves = 0
        self._grow(sample, leaves)
        self.dim, self.cut, self.low, self.high, self.leaf = (np.array(x) for x in (self.dim, self.cut, self.low, self.high, self.leaf))

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        me = len(self.dim)
        for column, value in ((self.dim, 0), (self.cut, 0.0), (self.low, -1), (self.high, -1), (self.leaf, -1)):
            column.append(value)
        if leaves > 1 and len(points) > 1:
            widest = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            cut = float(np.median(points[:, widest]))
            below = points[:, widest] < cut
            if not below.any():
                below = points[:, widest] <= cut
                cut = np.nextafter(cut, np.inf)
            if below.any() and not below.all():
                self.dim[me], self.cut[me] = widest, cut
                self.low[me] = self._grow(points[below], leaves // 2)
                self.high[me] = self._grow(points[~below], leaves - leaves // 2)
                return me
        self.leaf[me] = self.n_leaves
        self.n_leaves += 1
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        node = np.zeros(len(points), np.int64)
        while (open_ := np.flatnonzero(self.leaf[node] < 0)).size:
            at = node[open_]
            node[open_] = np.where(points[open_, self.dim[at]] < self.cut[at], self.low[at], self.high[at])
        return self.leaf[node]


def _matrix(batch, feats: Sequence[str]) -> np.ndarray:
    return np.stack([batch[c].to_numpy(np.float64) for c in feats], axis=1)


def _sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed in the order of the columns."""
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        d = a[:, c][:, None] - b[:, c][None, :]
        out += d * d
    return out


def _visited(visits: DataFrame, packed: DataFrame, feats: Sequence[str], id_col: str, k: int) -> DataFrame:
    """(id, nn_id, dist2): the k nearest of each visitor in each block; visits: (id, features, _leaf)."""
    load = visits.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    blocks = packed.join(load, "_leaf")  # one row a block; blocks nobody visits go
    blocks = blocks.select("_leaf", "_block", "_ids", "_data", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    split = packed.groupBy("_leaf").agg(F.max("_block").alias("_last")).join(load, "_leaf")
    dealt = visits.join(split, "_leaf").withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int"))
    dealt = dealt.select(id_col, *feats, "_leaf", "_chunk", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_block"))
    keys, kind = ["_leaf", "_block", "_chunk"], dict(visits.dtypes)[id_col]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({id_col: [], "nn_id": [], "dist2": []})
        ids = np.asarray(right["_ids"].iloc[0])
        points = np.frombuffer(right["_data"].iloc[0], np.float64).reshape(len(ids), len(feats))
        return pd.concat([nearest(left.iloc[at:at + SLICE], ids, points) for at in range(0, len(left), SLICE)])

    def nearest(left: pd.DataFrame, ids: np.ndarray, points: np.ndarray) -> pd.DataFrame:
        me = left[id_col].to_numpy()
        d = _sq_dists(_matrix(left, feats), points)
        d[me[:, None] == ids[None, :]] = np.inf  # no point is its own neighbour
        order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :k] if len(ids) > 1 else np.zeros((len(me), 1), np.int64)
        best = np.take_along_axis(d, order, axis=1)
        keep = np.isfinite(best)
        return pd.DataFrame({id_col: np.broadcast_to(me[:, None], best.shape)[keep], "nn_id": ids[order][keep], "dist2": best[keep]})

    return dealt.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(compare, f"{id_col} {kind}, nn_id {kind}, dist2 double")


def nearest_neighbours(points: DataFrame, features: Sequence[str], k: int, id_col: str = "rep",
                       seed: int = 42, visit_limit: int | None = None, report: dict | None = None) -> DataFrame:
    """Exact k nearest other points of each distinct point.

    points: (id_col, *features), one row per distinct point.
    visit_limit: visit so many leaves besides a point's own and stop, which is
    faster in many dimensions and not exact.  report: gets `compared`, the number
    of distances taken, and `points`.
    Returns (id_col, nn_rank 1..k, nn_id, dist2).
    """
    feats, spark = list(features), points.sparkSession
    kind = dict(points.dtypes)[id_col]
    pts = points.select(id_col, *[F.col(c).cast("double").alias(c) for c in feats])
    m = pts.count()
    if m < 2:
        return spark.createDataFrame([], f"{id_col} {kind}, nn_rank int, nn_id {kind}, dist2 double")
    k_eff = min(k, m - 1)
    sample = pts.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(SAMPLE).toPandas()
    splits = MedianSplits(_matrix(sample, feats), max(1, min(-(-m // BLOCK), SAMPLE // 4)))

    @F.pandas_udf("int")
    def leaf_of(*columns: pd.Series) -> pd.Series:
        return pd.Series(splits.of(np.stack([c.to_numpy(np.float64) for c in columns], axis=1)).astype(np.int32))

    placed = cut_lineage(pts.withColumn("_leaf", leaf_of(*feats)))
    boxes = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(feats)
                                                                       for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # one row a leaf
    number, n = boxes["_leaf"].to_numpy(), boxes["n"].to_numpy()
    low, high = (boxes[[f"{s}{i}" for i in range(len(feats))]].to_numpy() for s in ("lo", "hi"))
    sizes = spark.createDataFrame([(int(b), int(-(-s // BLOCK))) for b, s in zip(number, n, strict=True)], "_leaf int, _blocks int")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        return pd.DataFrame({"_leaf": frame["_leaf"].iloc[:1], "_block": frame["_block"].iloc[:1], "_ids": [frame[id_col].to_numpy()],
                             "_data": [_matrix(frame, feats).tobytes()]})

    blocks = placed.join(sizes, "_leaf").withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
    packed = cut_lineage(blocks.groupBy("_leaf", "_block").applyInPandas(pack, f"_leaf int, _block int, _ids array<{kind}>, _data binary"))

    def others(radius: bool, first: int | None, skip: int) -> Callable:
        """Leaves that a point visits, nearest first: those within its radius, less `skip` of them, at most `first`."""
        @F.pandas_udf("array<int>")
        def chosen(own: pd.Series, far: pd.Series, *columns: pd.Series) -> pd.Series:
            x, out = np.stack([c.to_numpy(np.float64) for c in columns], axis=1), []
            for own_leaf, r, row in zip(own.to_numpy(), far.to_numpy(np.float64), x, strict=True):
                gap = np.maximum(np.maximum(low - row, row - high), 0.0)
                gap = (gap * gap).sum(axis=1)
                order = np.lexsort((number, gap))
                order = order[number[order] != own_leaf][skip:]
                if radius:
                    order = order[gap[order] <= r * (1 + 1e-9) + 1e-300]
                out.append(number[order[:first]].astype(np.int32))
            return pd.Series(out, dtype=object)
        return chosen

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy(id_col).orderBy("dist2", "nn_id")  # k rows for each leaf that the point visited
        return cut_lineage(found.withColumn("nn_rank", F.row_number().over(w).cast("int")).where(F.col("nn_rank") <= k_eff))

    def radii(found: DataFrame) -> DataFrame:
        bound = found.where(F.col("nn_rank") == k_eff).select(id_col, F.col("dist2").alias("_far"))
        return placed.join(bound, id_col, "left").withColumn("_far", F.coalesce("_far", F.lit(float("inf"))))

    def compared(visits: DataFrame) -> None:
        if report is not None:
            held = spark.createDataFrame([(int(b), int(s)) for b, s in zip(number, n, strict=True)], "_leaf int, _n long")
            report["compared"] = report.get("compared", 0) + (visits.join(held, "_leaf").agg(F.sum("_n")).first()[0] or 0)
            report["points"] = m

    compared(placed)
    found = best(_visited(placed, packed, feats, id_col, k_eff))
    if len(number) > 1:
        near = NEAR if visit_limit is None else visit_limit
        for radius, first, skip in ((visit_limit is None, near, 0), *([(True, None, near)] if visit_limit is None else [])):
            visits = radii(found)
            visits = visits.withColumn("_leaf", F.explode(others(radius, first, skip)("_leaf", "_far", *feats))).select(id_col, *feats, "_leaf")
            visits = cut_lineage(visits)
            compared(visits)
            found = best(found.select(id_col, "nn_id", "dist2").unionByName(_visited(visits, packed, feats, id_col, k_eff)))
    return found.select(id_col, "nn_rank", "nn_id", "dist2")


def smote(df: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "id", k: int = 5,
          seed: int = 42, minority=None, n_samples: int | None = None) -> DataFrame:
    """Synthetic minority rows: (syn_id, base_id, nn_id, lam, *features, label).

    Default count lifts the minority class to the majority count.  Neighbours
    are the k nearest *distinct* minority points other than the base point
    (exact duplicates would interpolate to the base itself).
    """
    feats = list(features)
    sizes = class_sizes(df, label)
    if minority is None:
        minority = min(sizes, key=lambda c: (sizes[c], c))
    m = sizes.get(minority, 0)
    n_syn = n_samples if n_samples is not None else max(sizes.values()) - m
    spark = df.sparkSession
    schema = (f"syn_id bigint, base_id bigint, nn_id bigint, lam double, "
              + ", ".join(f"{c} double" for c in feats) + f", {label} int")
    if n_syn <= 0 or m < 2:
        if n_syn > 0:
            raise ValueError("SMOTE needs at least two minority rows")
        return spark.createDataFrame([], schema)

    rows = df.where(F.col(label) == minority).select(id_col, *[F.col(c).cast("double").alias(c) for c in feats])
    rows = rows.persist()
    missing = F.lit(False)
    for c in feats:
        missing = missing | F.col(c).isNull()
    if rows.where(missing).limit(1).count():
        raise ValueError("SMOTE features hold nulls in the minority class: impute them first")
    # distinct points; partial aggregation absorbs a heavily repeated point
    reps = rows.groupBy(*feats).agg(F.min(id_col).alias("rep"))
    nn = nearest_neighbours(reps, feats, k, "rep", seed)
    n_pts = reps.count()
    k_eff = min(k, n_pts - 1)
    if k_eff < 1:
        raise ValueError("SMOTE needs at least two distinct minority points")
    row_rep = rows.join(reps, feats)  # no feature is null here
    ranked = rank_by_value(row_rep, [], id_col, n_buckets=choose_buckets(m), rank_col="_r")

    s = spark.range(n_syn).withColumnRenamed("id", "syn_id")
    s = s.select("syn_id",
                 (F.floor(uniform(F.col("syn_id"), F.lit("base"), seed=seed) * m) + 1).cast("bigint").alias("_r"),
                 (F.floor(uniform(F.col("syn_id"), F.lit("nn"), seed=seed) * k_eff) + 1).cast("int").alias("nn_rank"),
                 uniform(F.col("syn_id"), F.lit("lam"), seed=seed).alias("lam"))
    base = s.join(ranked.select("_r", F.col(id_col).alias("base_id"), "rep", *[F.col(c).alias("x_" + c) for c in feats]),
                  "_r")
    with_nn = base.join(nn.select("rep", "nn_rank", "nn_id"), ["rep", "nn_rank"])
    nbr = reps.select(F.col("rep").alias("nn_id"), *[F.col(c).alias("n_" + c) for c in feats])
    j = with_nn.join(nbr, "nn_id")
    return j.select("syn_id", "base_id", "nn_id", "lam",
                    *[(F.col("x_" + c) + F.col("lam") * (F.col("n_" + c) - F.col("x_" + c))).alias(c) for c in feats],
                    F.lit(minority).cast("int").alias(label))


def smote_resample(df: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "id",
                   k: int = 5, seed: int = 42, keep_integers: Sequence[str] = ()) -> DataFrame:
    """Original rows plus synthetic ones (features + label + `synthetic` flag).
    `keep_integers` truncates those columns of the synthetic rows back to
    integers, as resampling an integer frame does; original rows stay as they are."""
    syn = smote(df, features, label, id_col, k, seed)
    orig = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias(label),
                     F.lit(False).alias("synthetic"))
    new = syn.select(*features, label, F.lit(True).alias("synthetic"))
    for c in keep_integers:
        new = new.withColumn(c, F.col(c).cast("bigint").cast("double"))
    return orig.unionByName(new)


def smote_vectors(df: DataFrame, features_col: str = "features", label: str = "label", k: int = 5,
                  seed: int = 42, weight_col: str | None = None) -> DataFrame:
    """SMOTE on an assembled vector column (for use inside a ResampledClassifier)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    first = df.select(vector_to_array(features_col).alias("a")).first()
    p = len(first["a"]) if first else 0
    cols = [f"_f{i}" for i in range(p)]
    arr = vector_to_array(F.col(features_col))
    wide = df.select(F.col(label).cast("int").alias(label), *[arr[i].alias(c) for i, c in enumerate(cols)])
    # a content hash as row id: deterministic on recomputation; equal ids only
    # for identical rows, which are interchangeable
    wide = wide.withColumn("_rid", F.xxhash64(label, *cols))
    out = smote_resample(wide, cols, label, "_rid", k, seed)
    res = out.select(array_to_vector(F.array(*cols)).alias(features_col), F.col(label).cast("double").alias(label))
    if weight_col:
        res = res.withColumn(weight_col, F.lit(1.0))
    return res
