"""Kneser-Ney costs by byte 5-grams, from counts sharded by context and joined with the n-grams of each split of documents.

A split of the documents (a partition of their scan) counts its distinct 5-grams by
language and kind of text: of no label, trusted of each fold, or toxic.  These
counts go to shards by the two bytes before the last one, so a shard holds whole
contexts of the orders 3 to 5.  Orders 1 and 2, which bytes bound, are summed
over all shards, as are the counts of counts for the discounts.  A shard fits
all models (trusted texts without each fold, all of them, toxic ones), joins them
with the splits' n-grams and returns the costs to those.  A split meets its
labels, and its costs, in the partition of its number: its rows are shuffled there
once, compressed, and read from there both times.  An n-gram without a cost is an
error: then a scan that was repeated has not given the same rows.

Costs are rounded to 32 bits once, in the shard, and summed in doubles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from calyx.llm.common import written

ORDER = 5
#: Orders from here on are fitted in the shards, lower ones over all of them.
SHARDED = 3
#: n-grams of a language that a split gathers before it adds up equal ones; as many as it has, if that is more.
PENDING = 1 << 18
SLICE = 1 << 19
#: Bytes of text a shard.
SHARD = 32 << 20
#: Rows that are handled at once.
BLOCK = 256
ADDED = ("lm_text binary, lm_named string, lm_lang string, lm_bytes long, lm_cost double, lm_worst double, lm_trusted boolean, "
         "lm_fold_cost double, lm_fold_worst double")


def codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """n-gram ending in each byte, texts beginning with zero bytes, and each text's size."""
    size = np.array([len(t) for t in texts], np.int64)
    before = b"\0" * (order - 1)
    data = np.frombuffer(before + b"".join(t + before for t in texts), np.uint8).astype(np.int64)
    code = np.zeros(len(data) - order + 1, np.int64)
    for k in range(order):
        code = code << 8 | data[k:len(data) - order + 1 + k]
    real = np.ones(len(code), bool)
    ends = np.cumsum(size + order - 1)
    for k in range(1, order):
        real[ends - k] = False
    return code[real], size


def _squeezed(sorted_keys: np.ndarray) -> bytes:
    return _bytes(np.diff(sorted_keys, prepend=0))


def _bytes(values: np.ndarray) -> bytes:
    """A number's bytes of equal rank side by side, compressed, behind their length."""
    plain = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(plain, asbytes=True)


def _values(held: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(held[:8], "little"), np.dtype(dtype).itemsize
    plain = pa.Codec("zstd").decompress(held[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, n).T).reshape(-1).view(dtype)


def _keys(held: bytes) -> np.ndarray:
    return np.cumsum(_values(held, np.int64))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n (rows by key)."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n[order], first, axis=0)


# ---- splits -----------------------------------------------------------------

def _itself(split: int) -> int:
    return split


def placed(messages: RDD, splits: int) -> RDD:
    """(split, message) in the partition of the split; a union of such is read one after the other, without a shuffle."""
    return messages.partitionBy(splits, _itself)


def blocks(rows: DataFrame) -> RDD:
    """(split, ("rows", ids, size, compressed rows)) for each BLOCK rows, or SLICE bytes, of a split of `rows`."""

    def closed(split: int, block: list[tuple]) -> tuple[int, tuple]:
        plain = pickle.dumps(block, pickle.HIGHEST_PROTOCOL)
        packed = pa.Codec("zstd", compression_level=3).compress(plain, asbytes=True)
        return split, ("rows", [row[0] for row in block if row[0] is not None], len(plain), packed)

    def run(split: int, part: Iterator[Row]) -> Iterator[tuple[int, tuple]]:
        block, size = [], 0
        for row in map(tuple, part):
            block.append(row)
            size += len(row[3] or b"")
            if len(block) >= BLOCK or size >= SLICE:
                yield closed(split, block)
                block, size = [], 0
        if block:
            yield closed(split, block)

    held = rows.rdd.mapPartitionsWithIndex(run)
    return placed(held, max(held.getNumPartitions(), 1))


def _opened(size: int, packed: bytes) -> list[tuple]:
    return pickle.loads(pa.Codec("zstd").decompress(packed, size, asbytes=True))


def _languages(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    named = np.array(langs, object)
    for lang in sorted(set(langs)):
        at = np.flatnonzero(named == lang)
        # a slice holds SLICE bytes, or one longer text
        piece = np.cumsum([len(texts[r]) for r in at]) // SLICE
        for rows in np.split(at, np.flatnonzero(np.diff(piece)) + 1):
            yield lang, rows, [texts[r] for r in rows]


def marks(parts: RDD, ids: DataFrame) -> RDD:
    """(split, ("mark", id, toxic)) of the labelled rows."""
    places = ids.sparkSession.createDataFrame(parts.flatMap(lambda x: [(key, x[0]) for key in x[1][1]]), "lm_id string, split int").distinct()
    found = places.join(written(ids, "kn-ids"), "lm_id").select("split", "lm_id", "toxic")
    return placed(found.rdd.map(lambda r: (r[0], ("mark", r[1], r[2]))), parts.getNumPartitions())


def _kinds(block: list[tuple], found: dict, folds: int) -> np.ndarray:
    """0 for a row without label, 1 + fold for a trusted one, folds + 1 for a toxic one."""
    return np.array([0 if text is None or key not in found else folds + 1 if found[key] else 1 + part for key, _, part, text, *_ in block], np.int64)


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last; a pair of bytes is in 16 shards at most, so what they sum of order 2 is bounded."""
    return (((code >> 8 & 0xFF) * 40503 >> 4) * 16 + ((code >> 16 & 0xFF) * 40503 >> 4) % 16) % shards


def counts(flagged: RDD, shards: int, folds: int) -> RDD:
    """(split, language, n-grams with kind, counts) in the partition of their shard; flagged: marks, then rows, of each split."""

    def run(split: int, part: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        found: dict[str, bool] = {}
        pending: dict[str, list] = {}
        for _, (what, *held) in part:
            if what == "mark":
                found[held[0]] = held[1]
                continue
            block = _opened(*held[1:])
            kind = _kinds(block, found, folds)
            for lang, at, texts in _languages([row[1] for row in block], [bytes(row[3] or b"") for row in block]):
                code, size = codes(texts)
                known = pending.setdefault(lang, [])
                known.append(np.unique(code << 3 | np.repeat(kind[at], size), return_counts=True))
                if sum(len(k) for k, _ in known[1:]) > max(PENDING, len(known[0][0])):
                    pending[lang] = [_summed(*(np.concatenate(c) for c in zip(*known)))]
        for lang in sorted(pending):
            key, n = _summed(*(np.concatenate(c) for c in zip(*pending.pop(lang))))
            n = np.where(key & 7, n, 0)
            shard = _shard(key >> 3, shards)
            order = np.argsort(shard, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(rows):
                    yield int(shard[rows[0]]), (split, lang, _squeezed(key[rows]), _bytes(n[rows]))

    return flagged.mapPartitionsWithIndex(run).partitionBy(shards, lambda shard: shard)


# ---- shards -----------------------------------------------------------------

def _gathered(messages: list[tuple], folds: int, pooled: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language, and of all together: n-grams of its documents and their counts by model."""
    rows: dict[str, list] = {}
    for _, (_, lang, key, n) in messages:
        rows.setdefault(lang, []).append((_keys(key), _values(n, np.int64)))
    out = {}
    for lang, held in rows.items():
        key, n = _summed(*(np.concatenate(c) for c in zip(*held)))
        code, at = np.unique(key >> 3, return_inverse=True)
        kinds = np.zeros((len(code), 8), np.int64)
        kinds[at, key & 7] = n
        trusted = kinds[:, 1:folds + 1].sum(axis=1, keepdims=True)
        out[lang] = code, np.hstack([trusted - kinds[:, 1:folds + 1], trusted, kinds[:, folds + 1:folds + 2]])
    if out:
        out[pooled] = _summed(*(np.concatenate(c) for c in zip(*out.values())))
    return out


def _lower(code: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of `order` with the number of distinct bytes before them."""
    return _summed(code & (1 << 8 * order) - 1, (n > 0).astype(np.int64))


def _of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum(axis=0) for k in (1, 2, 3, 4)])


def statistics(messages: RDD, folds: int, pooled: str) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: counts of counts of the sharded orders (order, 1 to 4, model), and the counts of order 2: at most 65,536 rows."""

    def run(part: Iterator[tuple]) -> Iterator[tuple[str, tuple]]:
        for lang, (code, n) in _gathered(list(part), folds, pooled).items():
            seen = n.any(axis=1)
            code, n = code[seen], n[seen]
            kinds = []
            for order in range(ORDER, SHARDED - 1, -1):
                kinds.append(_of_counts(n))
                code, n = _lower(code, n, order - 1)
            yield lang, (np.array(kinds[::-1]), code, n)

    def both(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], *_summed(np.r_[a[1], b[1]], np.r_[a[2], b[2]])

    return dict(messages.mapPartitions(run).reduceByKey(both).collect())


def _discounts(kinds: np.ndarray) -> np.ndarray:
    """Discount (0 to 3, model) of a count, from the counts of counts."""
    n = np.asarray(kinds, float)
    out = np.zeros((4, n.shape[1]))
    for m in range(n.shape[1]):
        y = n[0, m] / (n[0, m] + 2 * n[1, m]) if n[0, m] + n[1, m] else 0.5
        for k in (1, 2, 3):
            usual = k - (k + 1) * y * n[k, m] / n[k - 1, m] if n[k - 1, m] else 0.0
            out[k, m] = usual if 0.05 <= usual <= k - 0.05 else k / 2
    return out


def _order(context: np.ndarray, n: np.ndarray, discount: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Probabilities (row, model) of an order from its counts, rows of a context being neighbours; 0 counts back off."""
    if not len(context):
        return under
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(context)]))
    cut = np.take_along_axis(discount, np.minimum(n, 3), axis=0)
    total, back = (np.add.reduceat(x, first, axis=0)[of] for x in (n, cut))
    return np.where(total > 0, (n - cut + back * under) / np.maximum(total, 1), under)


def _small(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probabilities (pair of bytes, model) of order 2."""
    two = np.zeros((1 << 16, n.shape[1]), np.int64)
    two[code] = n
    one = (two.reshape(256, 256, -1) > 0).sum(axis=0)
    p1 = _order(np.zeros(256, np.int64), one, _discounts(_of_counts(one)), np.full(one.shape, 1 / 256))
    return _order(np.arange(1 << 16) >> 8, two, _discounts(_of_counts(two)), np.tile(p1, (256, 1)))


def chances(code: np.ndarray, n: np.ndarray, stats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """p (n-gram, model) of the last byte of each n-gram; n-grams in order, with their counts, whole contexts."""
    kinds, pairs, pair_counts = stats
    levels = [(code, n)]
    for order in range(ORDER - 1, SHARDED - 1, -1):
        levels.append(_lower(*levels[-1], order))
    low = levels[-1][0] & 0xFFFF
    under = _small(pairs, pair_counts)[low]
    for order, (here, held) in zip(range(SHARDED, ORDER + 1), levels[::-1]):
        if order > SHARDED:
            below = levels[ORDER - order + 1][0]
            under = p[np.searchsorted(below, here & (1 << 8 * (order - 1)) - 1)]
        p = _order(here >> 8, held, _discounts(kinds[order - SHARDED]), under)
    return p


def costs(messages: RDD, stats: dict, folds: int, pooled: str, own: float) -> RDD:
    """(split, ("costs", language, n-grams, costs by model))."""
    sent = messages.context.broadcast(stats)

    def run(part: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
        held, known = list(part), sent.value
        tables = _gathered(held, folds, pooled)
        if not tables:
            return
        all_codes, n = tables[pooled]
        mixed = chances(all_codes, n, known[pooled])
        alive = known[pooled][2].any(axis=0)
        for lang in sorted({m[1][1] for m in held}):
            code = tables[lang][0]
            p = mixed[np.searchsorted(all_codes, code)]
            if lang != pooled:
                p = np.where(known[lang][2].any(axis=0), own * chances(*tables[lang], known[lang]) + (1 - own) * p, p)
            cost = np.where(alive, -np.log(p), np.nan).astype(np.float32)
            for _, (split, of, key, _) in held:
                if of != lang:
                    continue
                key = _keys(key)
                here, at = np.unique(key >> 3, return_inverse=True)
                kinds = np.zeros((len(here), 8), bool)
                kinds[at, key & 7] = True
                kinds = np.hstack([kinds[:, 1:folds + 1], np.ones((len(here), 2), bool)])  # a fold's model is for its own texts
                given = np.where(kinds, cost[np.searchsorted(code, here)], np.float32(0))
                yield split, ("costs", lang, _squeezed(here), [_bytes(np.ascontiguousarray(given[:, m])) for m in range(given.shape[1])])

    return messages.mapPartitions(run)


# ---- scores -----------------------------------------------------------------

def _worst_sums(ratio: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    total, here = np.r_[0.0, np.cumsum(ratio)], np.arange(len(ratio))
    sums = total[1:] - total[np.maximum(np.repeat(start, size), here + 1 - window)]
    return np.maximum.reduceat(sums, start[size > 0])


def _tables(answers: list[tuple]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rows: dict[str, list] = {}
    for lang, key, values in answers:
        rows.setdefault(lang, []).append((_keys(key), np.stack([_values(v, np.float32) for v in values])))
    out = {}
    for lang, held in rows.items():
        key = np.concatenate([k for k, _ in held])
        order = np.argsort(key)
        out[lang] = key[order], np.concatenate([v for _, v in held], axis=1)[:, order]
    return out


def scored(docs: DataFrame, keys: dict[str, Column], ids: DataFrame, text: bool, folds: int, window: int, own: float, pooled: str) -> DataFrame:
    """`docs` without their text, with it as lm_text if `text`, and with ADDED: language as named and of the model, bytes, cost and worst window by all trusted texts, whether the row
    is trusted, and cost and worst window without its fold.  keys: lm_id, lm_named, lm_fold and lm_text (bytes) of a row;
    ids: (lm_id, toxic) of labelled rows."""
    spark = docs.sparkSession
    plain = docs.drop("text")
    rows = docs.select(*[keys[c].alias(c) for c in ("lm_id", "lm_named", "lm_fold", "lm_text")], *plain.columns)
    size = rows.agg(F.sum(F.octet_length("lm_text"))).first()[0] or 0
    parts = blocks(rows)
    found = marks(parts, ids)
    messages = counts(found.union(parts), 1 + size // SHARD, folds)
    stats = statistics(messages, folds, pooled)
    answers = placed(costs(messages, stats, folds, pooled, own), parts.getNumPartitions())
    alive = {lang: held[2].any(axis=0) for lang, held in stats.items()}
    none = np.zeros(folds + 2, bool)

    def judged(block: list[tuple], tables: dict, known_ids: dict) -> Iterator[tuple]:
        kind = _kinds(block, known_ids, folds)
        size = np.zeros(len(block), np.int64)
        cost, worst, fold_cost, fold_worst = np.full((4, len(block)), np.nan)
        able = alive.get(pooled, none)
        for lang, at, texts in _languages([row[1] for row in block], [bytes(row[3] or b"") for row in block]):
            code, size[at] = codes(texts)
            here, back = np.unique(code, return_inverse=True)
            known, values = tables.get(lang, (np.zeros(0, np.int64), np.zeros((folds + 2, 0), np.float32)))
            place = np.searchsorted(known, here)
            if len(here) and (place[-1] >= len(known) or (known[place] != here).any()):
                raise ValueError("a split's rows differ from those that were counted")
            here = place[back]
            toxic = values[folds + 1][here].astype(float)
            start = np.r_[0, np.cumsum(size[at])][:-1]
            by_all, by_others = np.full(len(at), folds), np.maximum(kind[at], 1) - 1
            for model, cost_to, worst_to in ((by_all, cost, worst), (by_others, fold_cost, fold_worst)):
                paid = values[np.repeat(model, size[at]), here].astype(float)
                sums = np.r_[0.0, np.cumsum(np.nan_to_num(paid))]
                cost_to[at] = sums[start + size[at]] - sums[start]
                if len(code):
                    worst_to[at[size[at] > 0]] = _worst_sums(np.nan_to_num(paid - toxic), start, size[at], window)
                cost_to[at[~able[model]]] = np.nan
                worst_to[at[~(able[model] & able[folds + 1])]] = np.nan
        trusted = (kind > 0) & (kind <= folds)
        fold_cost[~trusted] = fold_worst[~trusted] = np.nan
        added = ([None if x != x else x for x in column.tolist()] for column in (cost, worst, fold_cost, fold_worst))
        for row, n, good, *numbers in zip(block, size.tolist(), trusted.tolist(), *added):
            model = row[1] if alive.get(row[1], none)[folds] else pooled
            yield (*row[4:], row[3] if text else None, row[1], model, n, *numbers[:2], good, *numbers[2:])

    def run(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
        known_ids, given, tables = {}, [], None
        for _, (what, *held) in part:
            if what == "mark":
                known_ids[held[0]] = held[1]
            elif what == "costs":
                given.append(held)
            else:
                if tables is None:
                    tables = _tables(given)
                    given.clear()
                yield from judged(_opened(*held[1:]), tables, known_ids)

    added = spark.createDataFrame([], ADDED).schema
    return spark.createDataFrame(found.union(answers).union(parts).mapPartitions(run), StructType([*plain.schema.fields, *added.fields]), verifySchema=False)
