"""Vectors dealt into shards, queries into blocks, and every block brought to every shard.

A shard or a block is one row holding its ids and its matrix as bytes, of
bounded size: SHARD_ROWS and BLOCK_ROWS rows on average, dealt by a hash of the
id, so that no key can gather them.  Vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import spread_parts, written

SHARD_ROWS = 8192
BLOCK_ROWS = 1024


def finite(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part; a null id takes no part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def without_surplus_copies(ids: np.ndarray, mat: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ascending id order, less those that can be in no result: an equal vector comes with `keep` smaller ids.

    Repeated rows (one id, one vector) count once.
    """
    order = np.argsort(ids, kind="stable")
    ids, mat = ids[order], np.ascontiguousarray(mat[order])
    if len(ids) < 2:
        return ids, mat
    raw = mat.view(np.dtype((np.void, mat.dtype.itemsize * mat.shape[1]))).ravel()
    _, kind = np.unique(raw, return_inverse=True)
    by_kind = np.lexsort((ids, kind))
    k, i = kind[by_kind], ids[by_kind]
    first = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]
    by_kind = by_kind[first]
    k = k[first]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    place = np.arange(len(k)) - np.repeat(starts, np.diff(np.r_[starts, len(k)]))
    chosen = np.sort(by_kind[place < keep])
    return ids[chosen], mat[chosen]


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, dim)


def blocks(rows: DataFrame, name: str, per_block: int, build: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[DataFrame, int]:
    """Table (dim, <name>, <name>_data) of the bounded blocks of `rows`, and how many numbers <name> has."""
    n = max(1, -(-rows.count() // per_block))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data = build(part["vec_id"].to_numpy(np.int64), matrix(part["v"], int(key[0])))
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], f"{name}_data": [data]})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name))
    built = dealt.groupBy("dim", name).applyInPandas(one, f"dim int, {name} int, {name}_data binary")
    return written(built, f"vectors-{name}"), n


def grid(shards: tuple[DataFrame, int], queries: tuple[DataFrame, int]) -> DataFrame:
    """Every shard with every block of queries: dim, shard, block, shard_data, block_data; one task for each few pairs."""
    (left, n_shards), (right, n_blocks) = shards, queries
    keys = ["dim", "shard", "block"]
    parts = max(spread_parts(left.sparkSession), min(n_shards * n_blocks, 10_000))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)
