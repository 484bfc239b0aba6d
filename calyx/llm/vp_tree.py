"""Approximate nearest neighbours: a vantage-point tree per shard.

Every row is indexed.  A node keeps a vantage point and splits the other points
of its range at their median distance from it; each child knows the least and
the greatest of these distances.  By the triangle inequality a query at distance
d from the vantage point is at least max(d - greatest, least - d) away from all
points of a child.  The child is skipped if `relax` times this bound exceeds the
k-th distance found so far.  relax = 1 is exact search; a larger factor skips
more and may miss neighbours.  All queries of a block walk the tree together.

Queries are given rows of the table itself; their own row is no candidate.
Vectors that are null, empty, zero, or hold null or non-finite components, and
rows without an id, take no part.  Repeated rows count once.  Ties go to the
smaller id.  With fewer candidates than k all are returned.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm import vectors

LEAF = 64
#: 1 is exact search.
RELAX = 1.0
#: Distances computed at once.
CELLS = 1 << 21
#: Slack for the rounding of distances when a bound is compared.
ROUNDING = 1e-9
#: Stands where no neighbour was found.
NO_ID = np.iinfo(np.int64).max


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, queries x points, from component differences in double precision."""
    out = np.empty((len(queries), len(points)))
    step = max(1, CELLS // max(1, points.size))
    for lo in range(0, len(queries), step):
        gap = queries[lo:lo + step, None, :] - points[None, :, :]
        out[lo:lo + step] = np.sqrt(np.einsum("qpd,qpd->qp", gap, gap))
    return out


class Tree:
    """Points reordered so that a node is a range; children are (lo, hi) ranges with distance bounds."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, bounds: np.ndarray):
        self.ids, self.points, self.nodes, self.bounds = ids, points, nodes, bounds

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> "Tree":
        order, nodes, bounds = np.arange(len(ids)), [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            lo, hi, parent, side = waiting.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            nodes.append([lo, hi, -1, -1])
            bounds.append([0.0, 0.0, 0.0, 0.0])
            if hi - lo <= LEAF:
                continue
            part = order[lo:hi]
            # The point farthest from the first one: vantage points near a rim split best.
            far = int(np.argmax(distances(points[part], points[part[:1]])[0]))
            part[0], part[far] = part[far], part[0]
            d = distances(points[part[1:]], points[part[:1]])[0]
            rank = np.argsort(d, kind="stable")
            part[1:] = part[1:][rank]
            d, mid = d[rank], len(d) // 2
            bounds[me] = [d[0], d[mid - 1], d[mid], d[-1]]
            waiting += [(lo + 1, lo + 1 + mid, me, 0), (lo + 1 + mid, hi, me, 1)]
        return cls(ids[order], points[order], np.array(nodes, np.int64).reshape(-1, 4), np.array(bounds).reshape(-1, 4))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points, nodes=self.nodes, bounds=self.bounds)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        with np.load(io.BytesIO(data)) as f:
            return cls(f["ids"], f["points"], f["nodes"], f["bounds"])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), queries x k, nearest first; places without a neighbour have NO_ID and
        distance inf, as have neighbours whose distance is beyond the doubles' range."""
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), NO_ID)
        self.query_ids, self.queries, self.k, self.relax = query_ids, queries, k, relax
        self.measured = 0
        if len(self.ids) and len(queries):
            self._visit(0, np.arange(len(queries)))
        return self.found, self.best

    def _take(self, who: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Measure the points lo..hi for queries `who` and keep each query's best k."""
        d = distances(self.points[lo:hi], self.queries[who])
        self.measured += d.size
        ids = np.broadcast_to(self.ids[lo:hi], d.shape)
        seen = np.where(ids == self.query_ids[who, None], np.inf, d)
        near = np.flatnonzero((seen <= self.best[who, -1:]).any(axis=1))
        if len(near):
            w = who[near]
            all_d = np.concatenate([self.best[w], seen[near]], axis=1)
            all_i = np.concatenate([self.found[w], np.where(ids[near] == self.query_ids[w, None], NO_ID, ids[near])], axis=1)
            order = np.lexsort((all_i, all_d), axis=1)[:, :self.k]
            self.best[w], self.found[w] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        return d

    def _visit(self, node: int, who: np.ndarray) -> None:
        lo, hi, inner, outer = self.nodes[node]
        if inner < 0:
            self._take(who, lo, hi)
            return
        d = self._take(who, lo, lo + 1)[:, 0]
        near_lo, near_hi, far_lo, far_hi = self.bounds[node]
        floor = {inner: np.maximum(d - near_hi, near_lo - d), outer: np.maximum(d - far_hi, far_lo - d)}
        # A distance beyond the doubles' range bounds nothing.
        floor = {child: np.where(np.isfinite(least), least, 0.0) for child, least in floor.items()}
        first_in = floor[inner] <= floor[outer]
        for child, chosen in ((inner, first_in), (outer, ~first_in), (inner, ~first_in), (outer, first_in)):
            chosen = chosen & (self.relax * floor[child] * (1 - ROUNDING) - ROUNDING <= self.best[who, -1])
            if chosen.any():
                self._visit(child, who[chosen])


def nearest(table: DataFrame, is_query: Column, k: int = 10, relax: float = RELAX,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    rows = vectors.usable(table, id_col, vector_col, nonzero=True)

    def tree(ids: np.ndarray, points: np.ndarray) -> bytes:
        return Tree.build(*vectors.without_surplus_copies(ids, points, k + 1)).dump()

    def asked(ids: np.ndarray, points: np.ndarray) -> bytes:
        return Tree(*vectors.without_surplus_copies(ids, points, len(ids)), np.zeros((0, 4)), np.zeros((0, 4))).dump()

    shards = vectors.blocks(rows, "shard", vectors.SHARD_ROWS, tree)
    queries = vectors.blocks(rows.where(is_query), "block", vectors.BLOCK_ROWS, asked)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, block in zip(frame["shard_data"], frame["block_data"], strict=True):
                t, q = Tree.load(shard), Tree.load(block)
                ids, d = t.search(q.ids, q.points, k, relax)
                real = (ids != NO_ID) | np.isfinite(d)
                yield pd.DataFrame({"query_id": np.repeat(q.ids, real.sum(1)), "vec_id": ids[real], "score": d[real]})

    found = (vectors.grid(shards, queries).select("shard_data", "block_data")
             .mapInPandas(search, "query_id long, vec_id long, score double"))
    # Each shard sends k rows a query at most.
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
