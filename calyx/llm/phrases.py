"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Every
suffix of a piece, cut to MOST words, is a pointer into it.  Pointers are routed by
their language and leading two words, so all occurrences of a phrase meet, and each
group is sorted by multikey three-way quicksort: pointers with the pivot's word are
an equal partition, its size (with the counts of equal suffixes that tasks have
joined beforehand) is the count of the phrase so far, and it goes on with the next
word.  A partition of fewer than `least` occurrences is abandoned, as no phrase in
it can reach them; a small one is put in order at once.

Before that, pairs of adjacent words are counted by hash.  A pointer goes no further
than the first pair that is too rare (a bitmap of the others, 16 MB at most; a fuller
one prunes less and changes no result).  Leading pairs of over HOT occurrences are
routed by all their words: no group holds more than its share, and counts of their
beginnings are partial and summed.

A phrase a that is cut after k words into parts of counts l and r scores floor(2000000
a / (l + r)); the least over k counts, with ties to the smallest k.  Parts are at least
as frequent as the phrase, so the table of counts holds them all.

Words are told apart by 64 bits of hash; counting them compares the words themselves
too, and if two share a hash another hash function is taken.  Null texts are empty, a
null language is `und`; ids are not read, and every row counts, also repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.bitmaps import BITS_MOST, bit_of, bitmap_bits, has_bit, key_bitmap
from calyx.llm.common import row_slices, spread_parts, written
from calyx.llm.terms import text_bytes
from calyx.llm.words import mix

LEAST, MOST, TOP = 30, 4, 2000
#: A candidate inside a longer one with this share of its occurrences is dropped.
INSIDE = 80
PIECE_END, BLANK = rb".,;:!?" + bytes(range(0x0A, 0x0E)), b"\x20\x09"
#: Text handled at once inside a task.
SLICE = 2 << 20
#: Distinct entries held in a task before they are sent on.
HELD = 1 << 19
#: Occurrences of a leading pair from which its pointers are routed by all words.
HOT = 1 << 18
#: Pointers of a group, about.
GROUP = 1 << 19
#: Partitions of up to so many pointers are sorted at once.
SMALL = 1 << 11

_ENDS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(PIECE_END)] = True
_GAPS[list(PIECE_END + BLANK)] = True
_LEFT, _RIGHT = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


class Pieces:
    """Words of texts: `start` and `end` in `data` (lower-cased), `text` and `piece` that each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
        inside = ~_GAPS[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(_ENDS[self.data])[self.start]
        begins = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
        self.text = np.searchsorted(begins, self.start, "right") - 1

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word, never 0."""
        rng = np.random.default_rng(91_000 + seed)
        value = rng.integers(1, 1 << 63, 256, np.uint64)
        base, factor = (int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2, np.uint64))
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(self.data), b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        before = np.r_[np.uint64(0), np.cumsum(value[self.data] * up[:-1])]
        length = (self.end - self.start).astype(np.uint64)
        return np.maximum(mix((before[self.end] - before[self.start]) * down[self.start] + length * np.uint64(factor)), np.uint64(1))

    def spelled(self, which: np.ndarray) -> pa.Array:
        """The words with these numbers."""
        size = (self.end - self.start)[which]
        first = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[which] - first[:-1], size) + np.arange(first[-1])
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(self.data[at])]).cast(pa.string())


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + mix(right + _RIGHT))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of pieces of record batches with lang and text."""
    for batch in batches:
        for part in row_slices(batch, "text", SLICE):
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = text_bytes(part.column("text"))
            for lang in sorted(set(langs)):
                yield lang, [texts[i] for i in np.flatnonzero(langs == lang)]


class Held:
    """Rows of longs with counts, equal ones joined now and then; `full` when too many are held."""

    def __init__(self):
        self.rows, self.counts, self.since = [], [], 0

    def add(self, rows: np.ndarray, counts: np.ndarray | None = None) -> bool:
        self.rows.append(rows)
        self.counts.append(np.ones(len(rows), np.int64) if counts is None else counts)
        self.since += len(rows)
        if self.since > 2 * HELD:
            self.join()
        return self.since > HELD

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        order = np.lexsort(rows.T[::-1])
        rows, counts = rows[order], counts[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][:len(rows)])
        rows, counts = rows[first], np.add.reduceat(counts, first) if len(first) else counts
        self.rows, self.counts, self.since = [rows], [counts], len(rows)
        return rows, counts


# ---- counts of words and pairs ----------------------------------------------

def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, key, word, other, n): other differs from word if two words share the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches):
            p = Pieces(texts)
            a, b = p.hashes(seed), p.hashes(seed + 1000)
            order = np.lexsort((b, a))
            first = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][:len(order)])
            n = np.diff(np.r_[first, len(order)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(a[order[first]].view(np.int64)), p.spelled(order[first]), pa.array(n)],
                                             names=["lang", "key", "word", "n"])

    each = docs.mapInArrow(run, "lang string, key long, word string, n long")
    return written(each.groupBy("lang", "key").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n")), "phrase-words")


def pair_counts(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """(key, n) of adjacent words of a language that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def out() -> pa.RecordBatch:
            rows, n = held.join()
            held.__init__()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array(n)], names=["key", "n"])

        for lang, texts in by_language(batches):
            p = Pieces(texts)
            h = p.hashes(seed)
            near = np.flatnonzero(p.piece[1:] == p.piece[:-1])
            key, n = np.unique(in_language(lang, pair_key(h[near], h[near + 1])), return_counts=True)
            if held.add(key[:, None], n.astype(np.int64)) and len(held.join()[0]) > HELD:
                yield out()
        if held.rows:
            yield out()

    each = docs.mapInArrow(run, "key long, n long")
    return written(each.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-pairs")


def in_language(lang: str, key: np.ndarray) -> np.ndarray:
    """Keys of a language, mixed with its name."""
    name = np.uint64(0)
    for byte in lang.encode():
        name = mix(np.array([name ^ np.uint64(byte)]) + _LEFT)[0]
    return mix(key ^ name)


# ---- the sort ---------------------------------------------------------------

def three_way(words: np.ndarray, count: np.ndarray, least: int, least_inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointer, words, count) of each phrase of two words or more among suffixes `words` (0: none further) that occurs
    `least` times, or `least_inside` if it has fewer than all MOST words."""
    pointers, sizes, counts = [], [], []
    rows, most = words.shape
    todo = [(np.arange(rows), 0)] if rows else []

    def equal(part: np.ndarray, depth: int, total: int) -> None:
        """A partition whose words agree up to depth, that included."""
        if total < (least if depth + 1 == most else least_inside):
            return
        if depth:
            pointers.append(part[0])
            sizes.append(depth + 1)
            counts.append(total)
        if depth + 1 < most:
            part = part[words[part, depth + 1] != 0]
            if len(part):
                todo.append((part, depth + 1))

    floor = min(least, least_inside)
    while todo:
        part, depth = todo.pop()
        if count[part].sum() < floor:
            continue
        key = words[part, depth]
        if len(part) <= SMALL:
            order = np.argsort(key, kind="stable")
            part, key = part[order], key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = np.add.reduceat(count[part], first)
            ends = np.r_[first[1:], len(part)]
            for i in np.flatnonzero(total >= floor):
                equal(part[first[i]:ends[i]], depth, int(total[i]))
            continue
        pivot = np.sort(key[[0, len(key) // 2, len(key) - 1]])[1]
        below, above = key < pivot, key > pivot
        todo += [(part[side], depth) for side in (below, above) if side.any()]
        same = part[~(below | above)]
        equal(same, depth, int(count[same].sum()))
    return np.array(pointers, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)


def phrase_counts(docs: DataFrame, pairs: DataFrame, seed: int, least: int) -> DataFrame:
    """(lang, w1 .. w4, size, a): phrases of 2 to MOST words that occur `least` times or more; w are word keys, 0 beyond size."""
    spark = docs.sparkSession
    known = pairs.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") > HOT)).first()
    buckets = max(spread_parts(spark), int((known[1] or 0) // GROUP) + 1)
    bits, hot_bits = (min(bitmap_bits(n), BITS_MOST) for n in (known[0], known[2]))
    maps = spark.sparkContext.broadcast((key_bitmap(pairs.select("key"), bits), key_bitmap(pairs.where(F.col("n") > HOT).select("key"), hot_bits)))
    columns = [f"w{i + 1}" for i in range(MOST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = maps.value
        held: dict[str, Held] = {}

        def out(lang: str) -> pa.RecordBatch:
            rows, n = held.pop(lang).join()
            lead = in_language(lang, pair_key(rows[:, 0], rows[:, 1]))
            deep = has_bit(hot, bit_of(lead.view(np.int64), hot_bits))
            for i in range(2, MOST):
                lead = np.where(deep, mix(lead + rows[:, i]), lead)
            bucket = (lead % np.uint64(buckets)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(deep), pa.array(bucket),
                                               *(pa.array(rows[:, i].view(np.int64)) for i in range(MOST)), pa.array(n)], names=["lang", "deep", "bucket", *columns, "n"])

        for lang, texts in by_language(batches):
            p = Pieces(texts)
            h = p.hashes(seed)
            if len(h) < 2:
                continue
            go = (p.piece[1:] == p.piece[:-1]) & has_bit(frequent, bit_of(in_language(lang, pair_key(h[:-1], h[1:])).view(np.int64), bits))
            at = np.flatnonzero(go)
            go, h = np.r_[go, np.zeros(MOST, bool)], np.r_[h, np.zeros(MOST, np.uint64)]
            rows, on = np.zeros((len(at), MOST), np.uint64), np.ones(len(at), bool)
            rows[:, 0] = h[at]
            for i in range(1, MOST):
                on &= go[at + i - 1]
                rows[:, i] = np.where(on, h[at + i], np.uint64(0))
            keeper = held.setdefault(lang, Held())
            if keeper.add(rows) and len(keeper.join()[0]) > HELD // 2:
                yield out(lang)
        for lang in list(held):
            yield out(lang)

    def sort(key: tuple, group: pa.Table) -> pa.Table:
        words = np.stack([group.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
        at, size, a = three_way(words, group.column("n").to_numpy(), least, 1 if key[1].as_py() else least)
        found = np.where(np.arange(MOST) < size[:, None], words[at], np.uint64(0)) if len(at) else np.zeros((0, MOST), np.uint64)
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.string()), *(pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(MOST)),
                         pa.array(size.astype(np.int32)), pa.array(a)], names=["lang", *columns, "size", "a"])

    schema = ", ".join(f"{c} long" for c in columns)
    routed = docs.mapInArrow(run, f"lang string, deep boolean, bucket long, {schema}, n long")
    sizes = routed.groupBy("lang", "deep", "bucket").applyInArrow(sort, f"lang string, {schema}, size int, a long")
    out = written(sizes.groupBy("lang", *columns, "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrase-counts")
    maps.destroy()
    return out


# ---- scores -----------------------------------------------------------------

def _slice(first: Column, size: Column) -> list[Column]:
    """Word keys of a part of a phrase, 0 beyond its size."""
    words = F.array(*[f"w{i + 1}" for i in range(MOST)])
    return [F.when(F.lit(i) < size, F.get(words, first + i)).otherwise(F.lit(0)).alias(f"p{i + 1}") for i in range(MOST)]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, then a, then the phrase."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    seed = 0
    while (counts := word_counts(rows, seed)).where("word != other").limit(1).count():
        seed += 1
    columns, parts = [f"w{i + 1}" for i in range(MOST)], [f"p{i + 1}" for i in range(MOST)]
    words = written(counts.where(F.col("n") >= least).select("lang", "key", "word", "n"), "phrase-frequent")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    found = phrase_counts(rows, pair_counts(rows, seed, least), seed, least)
    known = words.select("lang", F.col("key").alias("p1"), *[F.lit(0).cast("long").alias(c) for c in parts[1:]], F.col("n").alias("f")).unionByName(
        found.select("lang", *[F.col(c).alias(p) for c, p in zip(columns, parts, strict=True)], F.col("a").alias("f")))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = known.withColumnRenamed("f", "l")
    right = known.withColumnRenamed("f", "r")
    cuts = cuts.select("*", *_slice(F.lit(0), F.col("k"))).join(left, ["lang", *parts]).drop(*parts)
    cuts = cuts.select("*", *_slice(F.col("k"), F.col("size") - F.col("k"))).join(right, ["lang", *parts]).drop(*parts)
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0)) div (l + r)"))
    best = cuts.groupBy("lang", *columns, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = found.where("size > 2").select("lang", *columns, "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"), "size")
    inside = inside.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("m"))).alias("at"))
    inside = inside.select("lang", "a", *_slice(F.col("at"), F.col("m"))).groupBy("lang", *parts).agg(F.max("a").alias("longer"))
    inside = inside.select("lang", *[F.col(p).alias(c) for c, p in zip(columns, parts, strict=True)], "longer")
    wide = "decimal(20, 0)"
    kept = best.join(inside, ["lang", *columns], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * INSIDE)).drop("longer")
    kept = written(kept, "phrase-kept")

    each = kept.select("lang", *columns, F.posexplode(F.slice(F.array(*columns), F.lit(1), F.col("size"))).alias("place", "key"))
    spelled = each.join(words.select("lang", "key", "word"), ["lang", "key"]).groupBy("lang", *columns).agg(
        F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelled = spelled.select("lang", *columns, F.array_join(F.col("words.word"), " ").alias("phrase"))
    listed = kept.join(spelled, ["lang", *columns]).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = listed.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # the best of each share first: no language is ranked whole in one task
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
