"""Ranked lexical search by bit-sliced Bloom signatures.

Every document is scored against every item of a table of queries, exactly:

    score = sum over the item's terms, repeats included, of w * ((10**9 tf) div (1000 tf + 12 m))

with w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - 25 + (25 n N) div L, n the
document's terms, N the documents with a term, L their terms, df the documents with
the query's term and tf its occurrences in the document.

A first scan counts N, L and df.  In a second one documents are taken in blocks of
similar size.  A block's signature has one row of bits for each hash value, one bit
in it for each document.  A term sets ROWS bits of its document for each level of
LEVELS that its tf reaches, so the conjunction of a query term's rows tells which
documents may hold it that often: never too few, at times too many.  Each document's
sum of the weights of the levels found, with tf at the top of the level, bounds its
score from above.  Documents whose bound isn't below the item's K-th best score so
far are scored exactly, best bounds first; all others provably can't be in the list.
Each task returns its K best of each item, and a window over these takes the K best.

Queries go to all tasks in blocks of at most QUERY_TERMS distinct terms and QUERY_ITEMS
items, two scans of the documents for each block; a task holds one slice of texts, its
signatures and one block's lists.

Terms are equal if 128 bits of hash are.  Null texts have no terms.  Rows of items
with equal id and text count once; items without terms, or whose terms occur
nowhere, have no rows.  Every document row is a document of its own, also with an id
that others have; rows without an id come after all others of equal score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import written
from calyx.llm.terms import Terms, term_batches
from calyx.llm.words import mix

K = 20
#: Least tf of each level.  The bound takes a level's top, one less than the next, or n for the last.
LEVELS = (1, 2, 3, 5, 9, 17)
#: Bits that a term sets for each level.
ROWS = 3
#: Signature rows for each distinct (term, level) of the block's largest document, rounded up to a power of two.
SPACE = 8
#: Documents of a block, fewer if (query terms) x (documents) would pass CELLS, but BLOCK_LEAST at least.
BLOCK, CELLS, BLOCK_LEAST = 512, 1 << 22, 8
#: Distinct terms and items of the queries that are sent to the tasks at once.
QUERY_TERMS, QUERY_ITEMS = 1 << 15, 1 << 14

_RANDOM = np.random.default_rng(19_700_101)
_VALUES = [_RANDOM.integers(1, 1 << 63, 256, np.uint64) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
_LENGTHS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def term_hashes(terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every term."""
    out, size = [], len(terms.data)
    length = (terms.end - terms.start).astype(np.uint64)
    for values, base, factor in zip(_VALUES, _BASES, _LENGTHS, strict=True):
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        before = np.r_[np.uint64(0), np.cumsum(values[terms.data] * up[:size])]
        out.append(mix((before[terms.end] - before[terms.start]) * down[terms.start] + length * np.uint64(factor)))
    return out[0], out[1]


class Counted:
    """Distinct terms of each text: `text`, hashes `a` and `b`, and `tf`, sorted by text and a; `size`, the terms of each text."""

    def __init__(self, terms: Terms):
        a, b = term_hashes(terms)
        order = np.lexsort((b, a, terms.text))
        text, a, b = terms.text[order], a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        self.text, self.a, self.b = text[at], a[at], b[at]
        self.tf = np.diff(np.r_[at, len(order)]).astype(np.int64)
        self.size = terms.per_text().astype(np.int64)


class Vocabulary:
    """Distinct query terms (a, b), sorted by a; two terms may share a."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        out = np.full(len(a), -1, np.int64)
        at = np.searchsorted(self.a, a)
        open_ = np.flatnonzero(at < len(self.a))
        while len(open_):
            same = self.a[at[open_]] == a[open_]
            open_ = open_[same]
            hit = self.b[at[open_]] == b[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.a)]
        return out


# ---- queries and statistics -------------------------------------------------

def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, item, a, b, qtf): distinct terms of each distinct item; item names it within the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, terms in term_batches(batches):
            c = Counted(terms)
            yield pa.RecordBatch.from_arrays([piece.column("item_id").take(pa.array(c.text)), piece.column("item").take(pa.array(c.text)), pa.array(c.a.view(np.int64)),
                                              pa.array(c.b.view(np.int64)), pa.array(c.tf)], names=["item_id", "item", "a", "b", "qtf"])

    rows = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("item", F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit("|"), F.col("text"))))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, item string, a long, b long, qtf long")


def query_blocks(terms: DataFrame, limit: int) -> list[DataFrame]:
    """`terms` in parts of whole items, cut until none has more than `limit` distinct terms or QUERY_ITEMS items; an item of
    more terms stands alone."""
    parts, out = [(terms, 1)], []
    while parts:
        part, cut = parts.pop()
        found = part.agg(F.count_distinct("a", "b").alias("terms"), F.count_distinct("item").alias("items")).first()
        if found["terms"] <= limit and found["items"] <= QUERY_ITEMS or found["items"] <= 1:
            out += [part] if found["items"] else []
            continue
        side = F.pmod(F.floor(F.pmod(F.xxhash64("item"), F.lit(1 << 40)) / F.lit(cut)), F.lit(2))
        parts += [(part.where(side == bit), cut * 2) for bit in (0, 1)]
    return out


def statistics(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """N, L, and df of each term of the vocabulary.  Tasks return sums, one row for each term that their share holds."""
    known = docs.sparkSession.sparkContext.broadcast((vocabulary.a, vocabulary.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(*known.value)
        df, n, total = np.zeros(len(words.a), np.int64), 0, 0
        for _, terms in term_batches(batches):
            c = Counted(terms)
            at = words.find(c.a, c.b)
            df += np.bincount(at[at >= 0], minlength=len(df))
            n += int((c.size > 0).sum())
            total += int(c.size.sum())
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, found]), pa.array(np.r_[n, total, df[found]])], names=["term", "n"])

    sums = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known.destroy()
    df = np.zeros(len(vocabulary.a) + 2, np.int64)
    df[sums.column("term").to_numpy() + 2] = sums.column("n").to_numpy()
    return int(df[0]), int(df[1]), df[2:]


# ---- signatures and bounds --------------------------------------------------

def _bits(a: np.ndarray, level: int, rows: int) -> Iterator[np.ndarray]:
    """Signature rows of (term, level)."""
    key = mix(a + np.uint64((level + 1) * _BASES[0] % (1 << 64)))
    for _ in range(ROWS):
        yield (key & np.uint64(rows - 1)).astype(np.int64)
        key = mix(key + np.uint64(_BASES[1]))


class Signature:
    """Bit slices of a block of documents: row r has a bit for each document that set it."""

    def __init__(self, doc: np.ndarray, a: np.ndarray, tf: np.ndarray, n_docs: int):
        level = [np.flatnonzero(tf >= least) for least in LEVELS]
        each = sum((np.bincount(doc[at], minlength=n_docs) for at in level), np.zeros(n_docs, np.int64))
        self.rows = 1 << max(6, int(SPACE * each.max(initial=1) - 1).bit_length())
        self.n_docs, width = n_docs, -(-n_docs // 8)
        slices = np.zeros(self.rows * width, np.uint8)
        for number, at in enumerate(level):
            bit = np.uint8(128) >> (doc[at] & 7).astype(np.uint8)
            for row in _bits(a[at], number, self.rows):
                np.bitwise_or.at(slices, row * width + (doc[at] >> 3), bit)
        self.slices = slices.reshape(self.rows, width)

    def present(self, a: np.ndarray) -> list[np.ndarray]:
        """For each level: which documents (columns) may hold which term (rows) as often, as booleans; levels end with the last that any may reach."""
        out, before = [], None
        for number in range(len(LEVELS)):
            both = before
            for row in _bits(a, number, self.rows):
                both = self.slices[row] if both is None else both & self.slices[row]
            if not both.any():
                break
            before = both
            out.append(np.unpackbits(both, axis=1, count=self.n_docs).astype(bool))
        return out


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def upper_parts(levels: list[np.ndarray], size: np.ndarray, m: np.ndarray) -> np.ndarray:
    """At most what each term adds to each document, before its weight, from the levels found."""
    out = np.zeros(levels[0].shape, np.int64) if levels else np.zeros((0, len(size)), np.int64)
    below = np.zeros(len(size), np.int64)
    for number, present in enumerate(levels):
        top = np.minimum(LEVELS[number + 1] - 1, size) if number + 1 < len(LEVELS) else size
        here = part_score(np.maximum(top, 1), m)
        out += present * np.maximum(here - below, 0)
        below = np.maximum(here, below)
    return out


class Lists:
    """The k best (score, order, text row) of each item so far in a task."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64) for _ in range(n_items)]
        self.doc = [np.zeros(0, np.int64) for _ in range(n_items)]
        self.null = [np.zeros(0, bool) for _ in range(n_items)]

    def least(self, item: int) -> int:
        """A document that scores less can't come in."""
        held = self.score[item]
        return int(held[-1]) if len(held) == self.k else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score > 0
        score, doc, null = np.r_[self.score[item], score[good]], np.r_[self.doc[item], doc[good]], np.r_[self.null[item], null[good]]
        best = np.lexsort((doc, null, -score))[:self.k]
        self.score[item], self.doc[item], self.null[item] = score[best], doc[best], null[best]


class Queries:
    """Items of a block: each one's term numbers and weights, qtf * w."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int):
        order = np.argsort(item, kind="stable")
        self.term, self.weight = term[order], weight[order]
        self.first = np.searchsorted(item[order], np.arange(n_items + 1))
        self.n_items = n_items

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.first[item], self.first[item + 1])
        return self.term[span], self.weight[span]


def search_block(doc: np.ndarray, a: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray, m: np.ndarray, ids: np.ndarray, null: np.ndarray,
                 words: Vocabulary, queries: Queries, lists: Lists) -> int:
    """Bring a block's documents into the lists; returns how many (item, document) were scored exactly.
    doc, a, term, tf: the block's distinct terms, term being the query term's number or -1."""
    signature = Signature(doc, a, tf, len(size))
    levels = signature.present(words.a)
    if not levels:
        return 0
    upper = upper_parts(levels, size, m).astype(np.float64)  # whole numbers; sums below 2**53 stay exact
    exact = np.zeros(upper.shape, np.int64)
    at = np.flatnonzero(term >= 0)
    exact[term[at], doc[at]] = part_score(tf[at], m[doc[at]])
    scored = 0
    for item in range(queries.n_items):
        terms, weight = queries.of(item)
        bound = weight.astype(np.float64) @ upper[terms]
        least = lists.least(item)
        may = np.flatnonzero(bound >= least)
        if len(may) > lists.k:  # best bounds first: their scores raise the least for the others
            may = may[np.argsort(-bound[may], kind="stable")]
            head, rest = may[:lists.k], may[lists.k:]
            lists.add(item, weight @ exact[np.ix_(terms, head)], ids[head], null[head])
            scored += len(head)
            may = rest[bound[rest] >= lists.least(item)]
        if len(may):
            lists.add(item, weight @ exact[np.ix_(terms, may)], ids[may], null[may])
            scored += len(may)
    return scored


# ---- the search -------------------------------------------------------------

def _ranked(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, query_limit: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, ties to the smaller doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    terms = written(query_terms(items), "search-queries")
    whole = None
    for part in query_blocks(terms, query_limit):
        best = written(_ranked(_block_lists(rows, part, k, kind), k, "item"), "search-lists")
        whole = best if whole is None else whole.unionByName(best)
    if whole is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return whole.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block_lists(rows: DataFrame, part: DataFrame, k: int, kind: str) -> DataFrame:
    """(item_id, item, doc_id, score): each task's best for the items of one block of queries."""
    spark = rows.sparkSession
    held = part.orderBy("item", "a", "b").toArrow()  # at most a block's terms
    a, b = (held.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    both = np.unique(np.rec.fromarrays([a, b], names="a,b"))
    words = Vocabulary(both["a"].copy(), both["b"].copy())
    names, item = np.unique(np.array(held.column("item").to_pylist(), object), return_inverse=True)
    item_ids = held.column("item_id").combine_chunks().take(pa.array(np.searchsorted(item, np.arange(len(names)))))
    n_docs, total, df = statistics(rows, words)
    if not n_docs:
        return spark.createDataFrame([], f"item_id {kind}, item string, doc_id long, score long")
    w = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    term = words.find(a, b)
    weight = held.column("qtf").to_numpy() * w[term]
    useful = df[term] > 0
    sent = spark.sparkContext.broadcast((words.a, words.b, item[useful], term[useful], weight[useful], [str(n) for n in names], item_ids, n_docs, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, item, term, weight, names, item_ids, n_docs, total = sent.value
        words, queries = Vocabulary(a, b), Queries(item, term, weight, len(names))
        lists = Lists(len(names), k)
        block = max(BLOCK_LEAST, min(BLOCK, CELLS // max(1, len(words.a))))
        for piece, terms in term_batches(batches):
            c = Counted(terms)
            found = words.find(c.a, c.b)
            ids = piece.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = 75 + 25 * c.size * n_docs // total
            first = np.searchsorted(c.text, np.arange(len(ids) + 1))
            distinct = np.diff(first)
            order = np.argsort(distinct, kind="stable")
            order = order[distinct[order] > 0]
            kinds = np.floor(np.log2(distinct[order])).astype(np.int64)  # a block's documents differ by less than twice
            cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(order) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                for at in range(lo, hi, block):
                    inside = order[at:min(at + block, hi)]
                    spans = np.concatenate([np.arange(first[d], first[d + 1]) for d in inside])
                    search_block(np.repeat(np.arange(len(inside)), distinct[inside]), c.a[spans], found[spans], c.tf[spans], c.size[inside], m[inside],
                                 ids[inside], null[inside], words, queries, lists)
        size = [len(s) for s in lists.score]
        at = np.repeat(np.arange(len(names)), size)
        yield pa.RecordBatch.from_arrays(
            [item_ids.take(pa.array(at)), pa.array([names[i] for i in at], pa.string()),
             pa.array(np.concatenate([*lists.doc, np.zeros(0, np.int64)]), mask=np.concatenate([*lists.null, np.zeros(0, bool)])),
             pa.array(np.concatenate([*lists.score, np.zeros(0, np.int64)]))], names=["item_id", "item", "doc_id", "score"])

    return rows.mapInArrow(run, f"item_id {kind}, item string, doc_id long, score long")
