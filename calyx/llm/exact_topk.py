"""Exact top-k inner products by three-phase uniform threshold.

A vector's components become integers, floor(1024 x), and its score with a query
is a sum over LISTS score lists: list l holds, for every object, the inner
product of the l-th part of the components.  Rows are dealt into shards; a shard
has its objects' entries of all lists.

1. Each shard sends each list's k best entries (with the object's entries of the
   other lists) and the list's minimum.  The k-th best sum of these is a safe
   cutoff c: k objects reach it.
2. The cutoff is joined to the blocks of queries.  Less the lists' minima, an
   object of the result sums to c - sum(minima) or more, so one of its LISTS
   entries is at least that over LISTS.  All such entries are collected.  An
   entry not sent is below the threshold: this bounds each object's sum from
   above, and the k-th best sum from below gives a better cutoff.
3. Objects whose upper bound misses it go; what is left is resolved exactly.

Queries are given rows of the table itself; their own row is no candidate.
Vectors that are null, empty or hold null or non-finite components, and rows
without an id, take no part; zero vectors do.  Repeated rows count once.  Ties go
to the smaller id.  Scores are 64-bit; a component beyond
2**16 is an error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm import vectors
from calyx.llm.common import written

LISTS = 2
#: Scores held at once in a task: queries x objects.
CELLS = 1 << 21
EXACT_DOUBLE = 1 << 53
#: Largest component: 2,048 products of such, times 1,024 each, stay below 2**63.
LARGEST = 1 << 16


def parts_of(dim: int) -> list[slice]:
    """The components of each list, of a vector of `dim` components."""
    edges = [dim * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def products(queries: np.ndarray, objects: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(objects).max(initial=0))) * max(1, queries.shape[1])
    if most < EXACT_DOUBLE:
        return (queries.astype(np.float64) @ objects.astype(np.float64).T).astype(np.int64)
    return queries @ objects.T


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _scored(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """For a few queries at a time: query ids, object ids, entries (lists x queries x objects), own places, cutoffs."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            with np.load(io.BytesIO(row.shard_data)) as s, np.load(io.BytesIO(row.block_data)) as q:
                ids, objects, asked, queries = s["ids"], s["mat"], q["ids"], q["mat"]
            cut = None
            if hasattr(row, "cut_data"):
                with np.load(io.BytesIO(row.cut_data)) as c:
                    order = np.argsort(c["ids"])
                    at = order[np.searchsorted(c["ids"], asked, sorter=order)]
                    cut = c["least"][at], c["need"][at]
            step = max(1, CELLS // max(1, len(ids)))
            for lo in range(0, len(asked), step):
                part = slice(lo, lo + step)
                entries = np.stack([products(queries[part, p], objects[:, p]) for p in parts_of(objects.shape[1])])
                own = asked[part, None] == ids[None, :]
                yield asked[part], ids, entries, own, (None if cut is None else (cut[0][part], cut[1][part]))


def _best(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Phase 1: each list's k best entries, and each list's minimum (as rows without an object)."""
    low = np.iinfo(np.int64).min
    for asked, ids, entries, own, _ in _scored(frames):
        n = entries.shape[2]
        for one in entries:
            ranked = np.where(own, low, one)
            top = np.argpartition(-ranked, min(k, n) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(asked)), top.shape[1])
            o = top.ravel()
            real = ~own[q, o]
            yield pd.DataFrame({"query_id": asked[q][real], "vec_id": ids[o][real],
                                **{f"e{j}": e[q, o][real] for j, e in enumerate(entries)}})
        yield pd.DataFrame({"query_id": asked, "vec_id": pd.array([None] * len(asked), "Int64"),
                            **{f"e{j}": e.min(axis=1) for j, e in enumerate(entries)}})


def _above(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phase 2: the entries at the threshold or above it; those below stay null."""
    for asked, ids, entries, own, (least, need) in _scored(frames):
        sent = (entries - least.T[:, :, None]) * LISTS >= need[None, :, None]
        q, o = np.nonzero(sent.any(axis=0) & ~own)
        if len(q):
            yield pd.DataFrame({"query_id": asked[q], "vec_id": ids[o],
                                **{f"e{j}": pd.Series(e[q, o]).astype("Int64").where(s[q, o])
                                   for j, (e, s) in enumerate(zip(entries, sent, strict=True))}})


def top_products(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score (long)."""
    rows = vectors.usable(table, id_col, vector_col, nonzero=False)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x * 1024).cast("double")).otherwise(
        F.raise_error(F.lit(f"a component beyond {LARGEST} leaves the range of 64-bit scores")))))
    lists = [f"e{j}" for j in range(LISTS)]
    schema = "query_id long, vec_id long, " + ", ".join(f"{e} long" for e in lists)

    def shard(ids: np.ndarray, mat: np.ndarray) -> bytes:
        ids, mat = vectors.without_surplus_copies(ids, mat, k + 1)
        return _dump(ids=ids, mat=mat.astype(np.int64))

    def block(ids: np.ndarray, mat: np.ndarray) -> bytes:
        ids, mat = vectors.without_surplus_copies(ids, mat, len(ids))
        return _dump(ids=ids, mat=mat.astype(np.int64))

    shards = vectors.blocks(rows, "shard", vectors.SHARD_ROWS, shard)
    queries = vectors.blocks(rows.where(is_query), "block", vectors.BLOCK_ROWS, block)

    # Phase 1
    first = vectors.grid(shards, queries).select("shard_data", "block_data").mapInPandas(lambda f: _best(f, k), schema)
    first = written(first, "topk-first")
    least = first.where("vec_id is null").groupBy("query_id").agg(*[F.min(e).alias(f"least_{e}") for e in lists])
    whole = sum((F.col(e) for e in lists[1:]), F.col(lists[0]))
    ranked = Window.partitionBy("query_id").orderBy(F.col("total").desc(), "vec_id")
    kth = (first.where("vec_id is not null").select("query_id", "vec_id", whole.alias("total")).distinct()
           .withColumn("place", F.row_number().over(ranked)).where(F.col("place") == k).select("query_id", "total"))
    minima = sum((F.col(f"least_{e}") for e in lists[1:]), F.col(f"least_{lists[0]}"))
    cutoffs = (least.join(kth, "query_id", "left")
               .withColumn("need", F.greatest(F.coalesce(F.col("total") - minima, F.lit(0)), F.lit(0))))
    cutoffs = written(cutoffs.select("query_id", "need", *[f"least_{e}" for e in lists]), "topk-cutoffs")

    # Phase 2: a block's cutoffs travel with the block.
    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data = _dump(ids=part["query_id"].to_numpy(np.int64), need=part["need"].to_numpy(np.int64),
                     least=part[[f"least_{e}" for e in lists]].to_numpy(np.int64))
        return pd.DataFrame({"block": [key[0]], "cut_data": [data]})

    cuts = (cutoffs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(queries[1])).cast("int"))
            .groupBy("block").applyInPandas(packed, "block int, cut_data binary"))
    armed = queries[0].join(cuts, "block").select("dim", "block", "block_data", "cut_data")
    second = (vectors.grid(shards, (written(armed, "topk-armed"), queries[1])).select("shard_data", "block_data", "cut_data")
              .mapInPandas(_above, schema))
    second = written(second, "topk-second")
    bounds = second.join(cutoffs, "query_id")
    for e in lists:
        bounds = (bounds.withColumn(f"low_{e}", F.coalesce(F.col(e), F.col(f"least_{e}")))
                  .withColumn(f"high_{e}", F.coalesce(F.col(e), F.col(f"least_{e}") + F.ceil(F.col("need") / LISTS))))
    bounds = bounds.select("query_id", "vec_id", *lists,
                           sum((F.col(f"low_{e}") for e in lists[1:]), F.col(f"low_{lists[0]}")).alias("low"),
                           sum((F.col(f"high_{e}") for e in lists[1:]), F.col(f"high_{lists[0]}")).alias("high"))
    by_low = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "vec_id")
    better = (bounds.withColumn("place", F.row_number().over(by_low)).where(F.col("place") == k)
              .select("query_id", F.col("low").alias("cutoff")))
    left = bounds.join(better, "query_id", "left").where(F.col("cutoff").isNull() | (F.col("high") >= F.col("cutoff")))

    # Phase 3
    known = left.where(F.col("high") == F.col("low")).select("query_id", "vec_id", F.col("low").alias("score"))
    unknown = left.where(F.col("high") != F.col("low")).select("query_id", "vec_id")
    ints = rows.select("vec_id", F.transform("v", lambda x: x.cast("long")).alias("v")).dropDuplicates(["vec_id"])
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.transform("v", lambda x: x.cast("long")).alias("qv")).dropDuplicates(["query_id"])
    resolved = unknown.join(asked, "query_id").join(ints, "vec_id").select(
        "query_id", "vec_id",
        F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (known.unionByName(resolved).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
