"""Substring dedup: windows of words that an earlier document has too, found by a compressed FM-index per shard.

A window is WINDOW consecutive words.  Of each window the word run of SEED words
with the least hash is its seed, so equal windows have equal seeds.  Consecutive
windows with one seed make a passage.  Passages are dealt into shards by their
seed, which brings all places of a window into one shard.

1. Seeds are counted over all documents.  A window that is in two documents has
   a seed that is in two, so passages of a seed seen once are left out, by a
   bitmap of the repeated seeds of BITS_MOST bits at most (a fuller one lets more
   passages through and changes no result).  A seed of HOT documents or more has
   its passages cut into single windows, dealt by their own hash, so no seed
   gathers rows in one task.
2. A task sends each shard its passages as one message of compressed columns: their
   words as numbers in the message's own dictionary, their rows and places.
3. A shard makes equal passages one class with the least doc_id that has it, joins
   its classes' words into one sequence and builds its FM-index:
   suffixes sorted on WINDOW symbols and more by prefix doubling, the preceding
   symbols kept in a wavelet matrix (one bit a symbol and level, with counts for
   every 64 bits).  The windows are then streamed through it: backward search
   extends all matches by one word a step, and a match whose interval holds a
   single place (its own) ends.  The intervals of those that reach the threshold
   of WINDOW words give the least doc_id that has the window.
4. The shard returns, for each of its passages, the runs of windows that a smaller
   doc_id has; each word in such a window is removed.

Words are compared by 64-bit hashes.  Null texts have no words.  Rows with a
null id are kept whole and are no source.  Rows that repeat an id don't remove
each other, as none is smaller.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.bitmaps import BITS_MOST, bit_of, bitmap_bits, has_bit, key_bitmap
from calyx.llm.common import row_slices, spread_parts, written
from calyx.llm.gram_shards import _bytes as packed, _keys as unpacked_keys, _summed, _values as unpacked
from calyx.llm.words import Words, mix, unique_in_text, word_batches

WINDOW = 13
SEED = 5
HOT = 500
#: Passages in a shard, about.
SHARD_PASSAGES = 40_000
#: Seeds, or words of passages, that a task holds before it sends them.
HELD = 1 << 21


# ---- seeds and passages -----------------------------------------------------

def passages(words: Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, seed hash, first window's place, windows) of every passage; places count words within the buffer."""
    grams, text, at = words.shingles(seed)
    n = window - seed + 1
    if len(at) < n:
        return tuple(np.zeros(0, d) for d in (np.int64, np.uint64, np.int64, np.int64))
    whole = len(at) - n + 1
    best, where = grams[:whole].copy(), np.arange(whole)
    for j in range(1, n):
        less = grams[j:j + whole] < best
        best[less] = grams[j:j + whole][less]
        where[less] = np.flatnonzero(less) + j
    inside = text[:whole] == text[n - 1:n - 1 + whole]
    best, where, first, text = best[inside], where[inside], at[:whole][inside], text[:whole][inside]
    if not len(first):
        return tuple(np.zeros(0, d) for d in (np.int64, np.uint64, np.int64, np.int64))
    new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (first[1:] != first[:-1] + 1)])
    return text[new], best[new], first[new], np.diff(np.r_[new, len(first)])


def _spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all the runs start..start + length, one after the other, and where each run begins among them."""
    begin = np.r_[0, np.cumsum(lengths)]
    return np.arange(begin[-1]) - np.repeat(begin[:-1] - starts, lengths), begin


def _prints(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the runs of words values[begin[i]:begin[i + 1]]."""
    place = (np.arange(len(values)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7):
        each = mix(values ^ mix(place + np.uint64(salt)))
        total = np.r_[np.uint64(0), np.cumsum(each)]
        out.append(mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, the rows that go there)."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(shard[rows[0]]), rows


def count_seeds(docs: DataFrame) -> DataFrame:
    """(seed, n): documents that have the seed, for those in two or more."""
    parts = spread_parts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], []

        def out() -> Iterator[pa.RecordBatch]:
            seed, count = _summed(np.concatenate(held), np.concatenate(n))
            for part, rows in _dealt((mix(seed) % np.uint64(parts)).astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(np.diff(seed[rows].view(np.int64), prepend=0))], pa.binary()),
                                                  pa.array([packed(count[rows])], pa.binary())], names=["part", "seeds", "counts"])
            held.clear()
            n.clear()

        for _, words in word_batches(batches, "text"):
            text, seed, _, _ = passages(words)
            seen, count = np.unique(seed[unique_in_text(text, seed)], return_counts=True)
            held.append(seen)
            n.append(count.astype(np.int64))
            if sum(map(len, held)) > HELD:
                yield from out()
        if held:
            yield from out()

    def total(part: pa.Table) -> pa.Table:
        seed = np.concatenate([unpacked_keys(x.as_py()) for x in part.column("seeds")])
        seed, n = _summed(seed, np.concatenate([unpacked(x.as_py(), np.int64) for x in part.column("counts")]))
        return pa.table({"seed": seed[n > 1], "n": n[n > 1]})

    messages = docs.select("text").mapInArrow(run, "part int, seeds binary, counts binary")
    return messages.groupBy("part").applyInArrow(total, "seed long, n long")


#: Columns of a message: of each passage, and of its words (numbers in the message's dictionary, and that).
MESSAGE = {"doc_id": np.int64, "text_hash": np.int64, "place": np.int32, "windows": np.int32, "word": np.uint32, "dictionary": np.int64}


def emit_passages(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """(shard, MESSAGE): passages of repeated seeds, as the tasks have them for each shard."""
    bits, hot_bits = 8 * len(repeated), 8 * len(hot)
    shared = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shared.value
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            shard, doc, key, place, windows = (np.concatenate([h[i] for h in held]) for i in range(5))
            values = np.concatenate([h[5] for h in held])
            held.clear()
            lengths = windows + (WINDOW - 1)
            start = np.cumsum(lengths) - lengths
            for number, rows in _dealt(shard):
                words, code = np.unique(values[_spans(start[rows], lengths[rows])[0]], return_inverse=True)
                data = {"doc_id": doc[rows], "text_hash": key[rows], "place": place[rows].astype(np.int32), "windows": windows[rows].astype(np.int32),
                        "word": code.astype(np.uint32), "dictionary": np.diff(words.view(np.int64), prepend=0)}
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([packed(data[c])], pa.binary()) for c in MESSAGE)], names=["shard", *MESSAGE])

        for piece, words in word_batches(batches, "text"):
            text, seed, first, windows = passages(words)
            chosen = has_bit(repeated, bit_of(seed, bits))
            text, seed, first, windows = text[chosen], seed[chosen], first[chosen], windows[chosen]
            if not len(seed):
                continue
            cut = has_bit(hot, bit_of(seed, hot_bits))
            at, _ = _spans(first[cut], windows[cut])
            owner = np.repeat(np.flatnonzero(cut), windows[cut])
            text, route = np.r_[text[~cut], text[owner]], np.r_[seed[~cut], np.zeros(len(at), np.uint64)]
            first, windows = np.r_[first[~cut], at], np.r_[windows[~cut], np.ones(len(at), np.int64)]
            span, begin = _spans(first, windows + WINDOW - 1)
            values = words.hash[span]
            single = np.arange(len(route)) >= len(route) - len(at)
            if len(at):  # a window of a hot seed goes by its own hash
                route[single] = _prints(values, begin)[0].view(np.uint64)[single]
            doc = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[text]
            key = piece.column("text_hash").to_numpy(zero_copy_only=False)[text]
            held.append(((mix(route) % np.uint64(parts)).astype(np.int64), doc, key, first - words.first[text], windows, values))
            size += len(values)
            if size > HELD:
                yield from out()
                size = 0
        if held:
            yield from out()

    return docs.mapInArrow(run, "shard int, " + ", ".join(f"{c} binary" for c in MESSAGE))


# ---- the index --------------------------------------------------------------

class WaveletMatrix:
    """Symbols as bit planes with counts per 64 bits; rank of a symbol before a place."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.planes, self.sums, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane = np.zeros(self.n // 64 + 1, np.uint64)
            plane.view(np.uint8)[:len(packed)] = packed
            self.planes.append(plane)
            self.sums.append(np.r_[0, np.cumsum(np.bitwise_count(plane).astype(np.int32))].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        part = self.planes[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.sums[level][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        lo, hi = np.zeros(len(at), np.int64), at
        for level in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - level)) & 1) == 1
            one_lo, one_hi = self.ones(level, lo), self.ones(level, hi)
            lo = np.where(bit, self.zeros[level] + one_lo, lo - one_lo)
            hi = np.where(bit, self.zeros[level] + one_hi, hi - one_hi)
        return hi - lo


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (a power of two is reached, or more)."""
    rank, d = symbols.astype(np.int64), 1
    n = len(symbols)
    order = np.argsort(rank, kind="stable")
    while d < depth:
        then = np.zeros(n, np.int64)
        then[:n - d] = rank[d:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + then
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        d *= 2
    return order


def earliest(words: list[bytes], least: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window of each class in turn: the least doc_id of all classes that have it."""
    parts = [np.frombuffer(w, np.uint64) for w in words]
    lengths = np.array([len(p) for p in parts], np.int64)
    distinct, code = np.unique(np.concatenate(parts), return_inverse=True)
    # Symbol 0 parts the classes.
    starts = np.r_[0, np.cumsum(lengths + 1)][:-1]
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    text[_spans(starts, lengths)[0]] = code + 1
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    order = suffix_order(text, WINDOW)
    doc_of = least[owner[order]]
    symbols = len(distinct) + 1
    before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
    index = WaveletMatrix(text[order - 1], max(1, int(symbols - 1).bit_length()))

    window_at, _ = _spans(starts, windows)
    result = least[np.repeat(np.arange(len(parts)), windows)].copy()
    live = np.arange(len(window_at))
    last = text[window_at + WINDOW - 1]
    lo, hi = before[last], before[last + 1]
    for step in range(WINDOW - 2, -1, -1):
        more = hi - lo > 1
        live, lo, hi = live[more], lo[more], hi[more]
        if not len(live):
            return result
        symbol = text[window_at[live] + step]
        lo, hi = before[symbol] + index.rank(symbol, lo), before[symbol] + index.rank(symbol, hi)
    more = hi - lo > 1
    live, lo, hi = live[more], lo[more], hi[more]
    if len(live):
        # Intervals of equally long matches are equal or apart.
        a, back = np.unique(lo, return_inverse=True)
        b = np.empty(len(a), np.int64)
        b[back] = hi
        edges = np.stack([a, np.minimum(b, len(doc_of) - 1)], axis=1).ravel()
        low = np.minimum.reduceat(doc_of, edges)[0::2]
        low = np.where(b == len(doc_of), np.minimum(low, doc_of[-1]), low)
        result[live] = low[back]
    return result


def removed_runs(shard: pa.Table) -> pa.Table:
    """(doc_id, text_hash, run): runs of windows of a shard's passages that a smaller doc_id has, each as its first place << 32
    and its number of windows."""
    held = {c: [] for c in ("doc_id", "text_hash", "place", "windows", "values")}
    for message in shard.to_pylist():
        data = {c: unpacked(message[c], kind) for c, kind in MESSAGE.items()}
        for c in ("doc_id", "text_hash", "place", "windows"):
            held[c].append(data[c].astype(np.int64))
        held["values"].append(np.cumsum(data["dictionary"]).view(np.uint64)[data["word"]])
    doc, key, place, windows, values = (np.concatenate(v) for v in held.values())
    begin = np.r_[0, np.cumsum(windows + WINDOW - 1)]
    print1, print2 = _prints(values, begin)
    order = np.lexsort((doc, print2, print1, windows))  # equal passages side by side, the least doc_id first
    same = [k[order][1:] == k[order][:-1] for k in (windows, print1, print2)]
    new = np.r_[True, ~(same[0] & same[1] & same[2])]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    found = earliest([values[begin[i]:begin[i + 1]].tobytes() for i in first], doc[first], windows[first])
    at, starts = _spans((np.cumsum(windows[first]) - windows[first])[of], windows)
    owner = np.repeat(np.arange(len(doc)), windows)
    gone = np.flatnonzero(found[at] < doc[owner])
    edge = np.flatnonzero(np.r_[True, (np.diff(gone) > 1) | (np.diff(owner[gone]) > 0)][:len(gone)])
    number = np.diff(np.r_[edge, len(gone)])
    begins, by = gone[edge], owner[gone[edge]]
    return pa.table({"doc_id": doc[by], "text_hash": key[by], "run": (place[by] + begins - starts[by]) << 32 | number})


# ---- the whole --------------------------------------------------------------

def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs): runs of windows that a smaller doc_id has too.  docs: doc_id long, text, text_hash."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null and text is not null")
    seeds = written(count_seeds(source), "substring-seeds", "zstd")
    n, places, n_hot = seeds.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") >= HOT)).first()
    parts = max(spread_parts(spark), -(-places // SHARD_PASSAGES))
    repeated = key_bitmap(seeds.select("seed"), min(bitmap_bits(n), BITS_MOST))
    # a false hit among the hot seeds cuts more passages, in all tasks alike
    hot = key_bitmap(seeds.where(F.col("n") >= HOT).select("seed"), min(bitmap_bits(n_hot), BITS_MOST))
    runs = emit_passages(source, repeated, hot, parts).groupBy("shard").applyInArrow(removed_runs, "doc_id long, text_hash long, run long")
    return written(runs.groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("runs")), "substring-runs", "zstd")


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words a window covers that begins at one of `starts`."""
    change = np.zeros(n + window + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, and the kept words joined by one space (`kept`), or their SHA-256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    gone = removed_windows(rows)
    last = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, "text"):
                counts, cut, kept = [], [], []
                for text, runs in zip(piece.column("text").cast(pa.binary()), piece.column("runs"), strict=True):
                    words = (text.as_py() or b"").split()
                    counts.append(len(words))
                    if runs.is_valid:
                        run = runs.values.to_numpy()
                        off = covered(len(words), _spans(run >> 32, run & 0xFFFFFFFF)[0])
                        words = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
                    cut.append(counts[-1] - len(words))
                    whole = b" ".join(words)
                    kept.append(hashlib.sha256(whole).hexdigest() if digests else whole.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(cut, pa.int64()),
                                                  pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    # A document's text_hash goes along, so that rows which share an id but not a text stay apart.
    both = rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")
