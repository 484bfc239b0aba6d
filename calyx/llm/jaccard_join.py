"""N-gram Jaccard join of documents, and the groups that its links form.

A document's set holds the hashes of its distinct word shingles.  Two documents
link when 100 * |A & B| >= percent * |A | B|.  Documents of equal sets are one
node, so a group of copies costs one row.

Candidates.  Sets are ordered by (frequent, hash); `frequent` marks shingles
common in a sample, which affects the order alone and so the work, not the
links.  Two linking sets of size n and m share one of the first
n - ceil(t n) + 1 elements of the one and likewise of the other.  Nodes that
share such an element meet in tiles (element, size band): a band spans the size
ratio t, so a node meets its own and the next smaller band.

Tests.  A signature is a bitmap in which each element flips the bit of its hash;
its length follows the set's size, and a longer one folds to a shorter one.
Bits that differ are no more than elements that differ, so a popcount bounds
the overlap from above.  Pairs that pass are intersected exactly as sorted
arrays.

Groups.  Links matter only between nodes not yet joined: two rounds test each
node against one leader, the node that leads most of its tiles, and join what
links; then all remaining pairs of a tile that are in different groups are
tested, at the first element they share (its places in both sets bound the
overlap).  A large group of near
copies thus costs its size, not the square of it, and no link between groups is
lost.

Null or empty texts and texts of white space have the empty set: they link with
nothing and are their own component.  So do rows with a null id.  A component's
id is the smallest id in it.  Repeated rows are kept.  Sets are taken
as equal when size and a 64-bit fingerprint agree.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.bitmaps import BITS_MOST, bit_of, bitmap_bits, has_bit, key_bitmap
from calyx.llm.common import written
from calyx.llm.components import components
from calyx.llm.words import per_text, unique_in_text, word_batches

#: Sampled share of documents, for the order of elements alone, and how many frequent shingles it names at most.
SAMPLE_EVERY = 16
FREQUENT = 1 << 17
FREQUENT_COUNT = 4
STAR_ROUNDS = 2


def _sets(words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by (text, hash): values, texts, offsets by text."""
    value, text, _ = words.shingles(n, short=True)
    at = unique_in_text(text, value)
    value, text = value[at], text[at]
    return value, text, per_text(len(words.count), text)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[np.uint64(0), np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _nodes(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each set."""
    from calyx.llm.words import mix

    size = np.diff(offsets).astype(np.uint64)
    return mix(_sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), offsets) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmap(values: np.ndarray) -> bytes:
    """Parity bitmap; its length is a power of two of at least half as many bits as elements, 64 at least."""
    bits = 1 << max(6, (max(1, len(values)) - 1).bit_length() - 1)
    flips = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles common in a sample of the documents: at most FREQUENT of them, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in word_batches(batches, "text", lower=True):
            value, _, _ = _sets(words, n)
            seen, count = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(SAMPLE_EVERY)) == 0).select("text")
    top = (sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= FREQUENT_COUNT).orderBy(F.col("n").desc(), "key").limit(FREQUENT).select("key").toArrow())
    return np.sort(top.column("key").to_numpy().astype(np.int64).view(np.uint64))


def document_sets(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_shingles, node (null for an empty set), bits (its signature), prefix (the elements by which it can
    be found, in their order)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, words in word_batches(batches, "text", lower=True):
            value, text, offsets = _sets(words, n)
            size = np.diff(offsets)
            common = np.isin(value, frequent)
            order = np.lexsort((value, common, text))
            place = np.arange(len(value)) - offsets[:-1][text]
            reach = size - (percent * size + 99) // 100 + 1
            chosen = place < reach[text]
            taken = np.minimum(reach, size)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(taken)].astype(np.int32)),
                                              pa.array(value[order][chosen].view(np.int64)))
            unnamed = np.asarray(piece.column("doc_id").is_null())
            node = pa.array(_nodes(value, offsets), mask=(size == 0) | unnamed)
            bits = pa.array([bitmap(value[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size.astype(np.int64)), node, bits, prefix],
                                             names=["doc_id", "n_shingles", "node", "bits", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, bits binary, prefix array<long>")


def node_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, items) of the `wanted` nodes (node): the sorted set, 8 bytes an element.

    The texts are read again where they lie; a bitmap of the wanted nodes, if it fits, leaves out most of the others
    before the join that leaves out all.
    """
    bits = bitmap_bits(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, bits) if bits <= BITS_MOST else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in word_batches(batches, "text", lower=True):
            value, _, offsets = _sets(words, n)
            node = _nodes(value, offsets)
            chosen = np.arange(len(node)) if shared.value is None else np.flatnonzero(has_bit(shared.value, bit_of(node, bits)))
            chosen = chosen[np.unique(node[chosen], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(node[chosen]), pa.array([value[offsets[i]:offsets[i + 1]].tobytes() for i in chosen], pa.binary())],
                                             names=["node", "items"])

    found = docs.where("doc_id is not null").select("text").mapInArrow(run, "node long, items binary")
    return written(found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "jaccard-sets")


def links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those (a, b) of `pairs` that link: first by signature, then by exact intersection."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(f"size_{s}").to_numpy() for s in "ab")
            apart = np.array([differing_bits(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            most = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            good = 100 * most >= percent * (na + nb - most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = {s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    passed = written(pairs.join(of["a"], "a").join(of["b"], "b").mapInArrow(may, "a long, b long"), "jaccard-passed")
    wanted = written(passed.select(F.col("a").alias("node")).union(passed.select("b")).distinct(), "jaccard-wanted")
    sets = node_sets(docs, n, wanted)
    items = (passed.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").mapInArrow(do, "a long, b long"))
    return written(items, "jaccard-links")


def jaccard_groups(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links), node."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = written(document_sets(docs, n, percent, frequent_shingles(docs, n)), "jaccard-members")
    t = percent / 100

    # Tiles: elements of prefixes that several nodes share.
    nodes = members.where("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("size"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    nodes = written(nodes, "jaccard-nodes")
    keys = nodes.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-shared")
    tiles = written(keys.join(shared, "key"), "jaccard-tiles")
    # The text that others are copies of has the most shared elements and the fewest of its own: the best leader.
    central = written(tiles.groupBy("node").agg((F.sum("n") / F.first("size")).alias("central")), "jaccard-central")
    tiles = written(tiles.drop("n").join(central, "node"), "jaccard-ranked")

    edges, groups, tested = None, None, None
    fits = (F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * percent)
    for r in range(STAR_ROUNDS):
        rank = F.col("central") if r == 0 else F.xxhash64(F.lit(r), "node").cast("double")
        lead = tiles.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), F.col("node").alias("other"), F.col("size").alias("other_size"))).alias("lead"))
        lead = written(lead.select("key", "lead.other", "lead.other_size"), "jaccard-leaders")
        votes = tiles.join(lead, "key").where(fits & (F.col("node") != F.col("other"))).groupBy("node", "other").agg(F.count("*").alias("n"))
        if groups is not None:
            votes = other_groups(votes, groups).join(tested.select(F.col("a").alias("node"), F.col("b").alias("other")), ["node", "other"], "left_anti")
        pairs = votes.groupBy("node").agg(F.max(F.struct("n", "other")).alias("best")).select(F.col("node").alias("a"), F.col("best.other").alias("b"))
        pairs = written(pairs, "jaccard-pairs")
        found = links(pairs, nodes, docs, n, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        groups = components(edges)

    # What is left: tiles whose nodes are in several groups.
    placed = tiles.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed, "jaccard-placed")
    mixed = written(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"), "jaccard-mixed")
    band = F.floor(F.log(F.col("size").cast("double")) / -math.log(t) + 1e-9)
    placed = written(placed.join(mixed, "key").withColumn("band", band.cast("int")), "jaccard-open")
    other = placed.select("key", F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("at").alias("other_at"),
                          F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("comp").alias("other_comp"))
    smaller = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("node") < F.col("other")))
    # At the first element that two linking sets share, what follows in both is enough for the overlap they need.
    needed = F.ceil(percent * (F.col("size") + F.col("other_size")) / F.lit(100 + percent))
    reach = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) >= needed
    rest = (placed.join(other, ["key", "band"]).where(smaller & fits & reach & (F.col("comp") != F.col("other_comp")))
            .select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    edges = edges.unionByName(links(written(rest, "jaccard-rest"), nodes, docs, n, percent))
    groups = components(edges)

    labelled = members.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    labelled = written(labelled.withColumn("comp", F.coalesce("comp", "node")), "jaccard-labelled")
    least = written(labelled.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least_id")), "jaccard-least")
    return labelled.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), "node")


def other_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (node, other, n) whose nodes aren't yet in one group."""
    a = groups.select("node", F.col("comp").alias("comp_a"))
    b = groups.select(F.col("node").alias("other"), F.col("comp").alias("comp_b"))
    both = pairs.join(a, "node", "left").join(b, "other", "left")
    return both.where(F.coalesce("comp_a", "node") != F.coalesce("comp_b", "other")).select("node", "other", "n")


def one_of_each_group(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`docs` less all but one document of each group: the one with the smallest id stays (of rows alike in id, one)."""
    groups = jaccard_groups(docs, n, percent)
    keep = groups.where(F.col("node").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi")
    nulls = kept.where("doc_id is null")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(nulls)
