"""Toxicity by class-conditional Kneser-Ney models of toxic and ordinary text.

A word (see terms.py) is spelled with a space before and after it and cut into
chunks of up to eight symbols; the first begins with the space, so a chunk, held
as its bytes in one long, is an exact key and says whether it begins a word.
Symbols are predicted by all symbols of their chunk before them.

Counts of both classes together make the shared model, interpolated modified
Kneser-Ney over the orders ORDERS, the lower ones from numbers of distinct longer
contexts.  A class's model is interpolated with it at full order:

    p_c(x|ctx) = (max(n_c(ctx x) - D, 0) + (D types_c(ctx) + SHARED) p(x|ctx)) / (n_c(ctx) + SHARED)

so expressions that are rare in a class have the shared probability in it.  After
a context that toxic text lacks both classes use the shared counts, and their
ratio is 1.  The smaller class leaves more to what it has not seen, so a symbol
that toxic text lacks may lower the ratio but not raise it.  A chunk's log ratio is the sum over its symbols of ln p_toxic - ln
p_ordinary.  Every chunk of a document is scored.  Its log ratio is the sum over all
chunks divided by their number (plus LENGTH), its evidence the sum of what exceeds
MARGIN in each divided by the square root of that, its score a logistic function of
the two.  Between them the ratio of every chunk moves the score.

The function's three numbers come from documents that the model has not seen: one
fold of the training documents is scored by a model of the others.

All tables are sharded by chunk and joined.  The corpus is read twice: for counts
of labelled texts (found by a bitmap of ids before they are shuffled), and for
scores.  There a task turns SPLIT bytes of text at a time into the distinct chunks
and, for each document, their numbers and counts.  The splits' distinct chunks are
joined with the models, and each split gets the log ratios of its own.

Null texts count as empty; an empty text's log ratio and evidence are 0.  Rows with a null id and
repeated rows are scored like others; label rows with a null id or a null class are
ignored, and an id is toxic if any of its rows is.  With one class only, every score
is that class.  Without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calyx.llm.bitmaps import BITS_MOST, bit_of, bitmap_bits, has_bit, key_bitmap
from calyx.llm.common import written
from calyx.llm.gram_shards import _bytes as packed, _keys as unpacked_keys, _values as unpacked
from calyx.llm.terms import Terms, term_batches

SYMBOLS = 8
#: Symbols of an n-gram of each order, the last one predicted.
ORDERS = (8, 5, 3, 1)
#: Weight of the shared distribution in a class's, in symbols, beside the discounts.
SHARED = 5.0
DISCOUNT = 0.75
MARGIN = 2.0
LENGTH = 10
#: crc32(doc_id as text) modulo FOLDS: 0 is never learned from, CALIBRATION sets the logistic function.
FOLDS = 5
CALIBRATION = 4
#: Distinct chunks held in a task before they are counted out.
HELD = 1 << 19
#: Bytes of text whose distinct chunks are looked up together.
SPLIT = 1 << 25
#: Codes below this, of two symbols at most, are sent to tasks; longer ones are joined, as no few of them begin most chunks.
SHORT = 1 << 16
#: Steps of evidence and of log ratios: sums of whole numbers don't depend on their order.
UNIT = 1_000_000
BINS, BIN = 4096, 0.02
#: Log ratios have so many bins on either side of 0.
RATIO_BINS, RATIO_BIN = 64, 0.03125


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


# ---- chunks -----------------------------------------------------------------

def chunks(terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(code, text) of every chunk."""
    length = terms.end - terms.start + 2
    each = -(-length // SYMBOLS)
    word = np.repeat(np.arange(len(length)), each)
    place = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
    at = terms.start[word] - 1 + SYMBOLS * place
    size = np.minimum(terms.end[word] + 1 - at, SYMBOLS)
    data = np.r_[terms.data, np.zeros(SYMBOLS, np.uint8)]
    code = np.zeros(len(at), np.uint64)
    for j in range(SYMBOLS):
        code = code << np.uint64(8) | data[at + j]
    return code >> (8 * (SYMBOLS - size)).astype(np.uint64), terms.text[word]


def beginnings(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which codes, their beginnings) for each number of symbols left out."""
    for cut in range(SYMBOLS):
        short = code >> np.uint64(8 * cut)
        has = np.flatnonzero(short)
        if not len(has):
            return
        yield has, short[has]


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(keys), return_inverse=True)
    return code, np.bincount(where, np.concatenate(sums)).astype(np.int64)


# ---- counts and models ------------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, kind) of the documents to learn from; kind is 2 * toxic, plus 1 in the calibration fold."""
    ids = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
           .withColumn("part", remainder(F.col("doc_id"))).where("part != 0")
           .select("doc_id", (2 * F.col("bad") + (F.col("part") == CALIBRATION).cast("int")).alias("kind")))
    ids = written(ids, "tox-ids")
    bits = min(bitmap_bits(ids.count()), BITS_MOST)
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(key_bitmap(ids.select(F.xxhash64(F.col("doc_id").cast(kind)).alias("key")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(has_bit(known.value, bit_of(key, bits)))).drop_columns(["key"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("key"))
    rows = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType())]))
    texts = written(rows.join(ids.hint("shuffle_hash"), "doc_id").select("text", "kind"), "tox-text", "zstd")
    known.destroy()
    return texts


def node_counts(texts: DataFrame) -> DataFrame:
    """(model, code, bad, good): how often the beginning `code` of a chunk occurs in toxic and in ordinary texts.  Model 1
    is of all texts, model 0 leaves out the calibration fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, (keys, sums) in held.items():
                code, n = _summed(keys, sums)
                spread = [(short, n[has]) for has, short in beginnings(code)]
                code, n = _summed([s for s, _ in spread], [k for _, k in spread])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], names=["kind", "code", "n"])
            held.clear()

        for piece, terms in term_batches(batches):
            code, text = chunks(terms)
            kinds = piece.column("kind").to_numpy()[text]
            for kind in np.unique(kinds).tolist():
                found, n = np.unique(code[kinds == kind], return_counts=True)
                keys, sums = held.setdefault(kind, ([], []))
                keys.append(found)
                sums.append(n)
                if len(keys) >= 8:
                    found, n = _summed(keys, sums)
                    held[kind] = [found], [n]
            if sum(len(k) for keys, _ in held.values() for k in keys) > HELD:
                yield from out()
        if held:
            yield from out()

    each = texts.mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    models = F.when(F.col("kind") % 2 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    bad = F.col("kind") >= 2
    each = each.select("kind", "code", "n", F.explode(models).alias("model")).groupBy("model", "code").agg(
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(bad, 0).otherwise(F.col("n"))).alias("good"))
    return written(each, "tox-counts", "zstd")


def _suffix(code: str, symbols: int) -> Column:
    return F.col(code) if symbols == SYMBOLS else F.col(code).bitwiseAND(F.lit((1 << 8 * symbols) - 1))


def shared_model(counts: DataFrame) -> DataFrame:
    """(model, code, p): interpolated modified Kneser-Ney probability of each code's last symbol, over both classes."""
    tables = [counts.select("model", "code", (F.col("bad") + F.col("good")).alias("n"))]
    for symbols in ORDERS[1:]:
        tables.append(written(tables[-1].groupBy("model", _suffix("code", symbols).alias("code")).agg(F.count("*").alias("n")), "tox-order"))
    lower = None
    for symbols, rows in reversed(list(zip(ORDERS, tables, strict=True))):
        rows, n = rows.withColumn("ctx", F.shiftrightunsigned("code", 8)), F.col("n")
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(k: int) -> Column:
            usual = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            return F.when(usual.between(0.05, k - 0.05), usual).otherwise(F.lit(k / 2)).alias(f"d{k}")

        cuts = (rows.groupBy("model").agg(*[F.sum((n == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
                .select("model", *[discount(k) for k in (1, 2, 3)]))
        rows = rows.join(F.broadcast(cuts), "model")  # one row a model
        rows = rows.withColumn("cut", F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.join(rows.groupBy("model", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare")), ["model", "ctx"])
        if lower is None:
            under = F.lit(1 / 256)
        else:
            short = lower.select("model", F.col("code").alias("short"), F.col("p").alias("under"))
            rows, under = rows.withColumn("short", _suffix("code", lower_symbols)).join(short, ["model", "short"]), F.col("under")
        lower, lower_symbols = written(rows.select("model", "code", ((n - F.col("cut") + F.col("spare") * under) / F.col("total")).alias("p")), "tox-p"), symbols
    return lower


def lexicon(counts: DataFrame) -> DataFrame:
    """(model, code, whole, beyond): log ratio of a chunk that is `code`, and of one that begins with `code` and goes on
    as no learned chunk does, for all codes that follow a context of toxic text, and for 0, the beginning of every chunk."""
    nodes = counts.join(shared_model(counts), ["model", "code"]).withColumn("ctx", F.shiftrightunsigned("code", 8))
    contexts = nodes.groupBy("model", "ctx").agg(*[f(c).alias(f"{c}_{name}") for c in ("bad", "good") for name, f in (
        ("total", F.sum), ("types", lambda c: F.sum((F.col(c) > 0).cast("long"))))]).where("bad_total > 0")

    def unseen(c: str) -> Column:
        return (DISCOUNT * F.col(f"{c}_types") + SHARED) / (F.col(f"{c}_total") + SHARED)

    def chance(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (F.col(f"{c}_total") + SHARED) + unseen(c) * F.col("p")

    step, end = F.log(chance("bad")) - F.log(chance("good")), F.log(unseen("bad")) - F.log(unseen("good"))
    step = F.when(F.col("bad") > 0, step).otherwise(F.least(step, F.lit(0.0)))
    steps = nodes.join(contexts, ["model", "ctx"]).select("model", "ctx", "code", step.alias("step"))
    ends = contexts.select("model", F.col("ctx").alias("code"), F.least(end, F.lit(0.0)).alias("end"))
    steps = steps.join(ends, ["model", "code"], "left").withColumn("end", F.coalesce("end", F.lit(0.0)))
    steps = written(steps.withColumn("depth", F.ceil(F.length(F.bin("code")) / 8).cast("int")), "tox-steps", "zstd")
    root = ends.where("code = 0").select("model", "code", F.lit(0.0).alias("whole"), F.col("end").alias("beyond"))
    whole = above = written(root, "tox-level", "zstd")
    for symbols in range(1, SYMBOLS + 1):
        level = steps.where(F.col("depth") == symbols)
        level = level.join(above.select("model", F.col("code").alias("ctx"), F.col("whole").alias("before")), ["model", "ctx"])
        level = level.withColumn("whole", F.col("before") + F.col("step"))
        above = written(level.select("model", "code", "whole", (F.col("whole") + F.col("end")).alias("beyond")), "tox-level", "zstd")
        whole = whole.unionByName(above)
    return whole


# ---- scores -----------------------------------------------------------------

def chunk_ratios(codes: DataFrame, words: DataFrame) -> DataFrame:
    """(code, ratio) of each row of `codes`, distinct chunks: that of its longest known beginning; words as for `evidence`."""
    few = F.col("code").between(0, SHORT - 1)
    cuts = F.array(*[F.struct(F.shiftrightunsigned("code", 8 * cut).alias("code"), F.lit(cut).alias("cut")) for cut in range(SYMBOLS - 2)])
    starts = F.filter(cuts, lambda s: ~s["code"].between(0, SHORT - 1))
    pairs = codes.select(F.col("code").alias("chunk"), F.explode(starts).alias("s")).select("chunk", F.col("s.code").alias("code"), F.col("s.cut").alias("cut"))
    ratio = F.when(F.col("cut") == 0, F.col("whole")).otherwise(F.col("beyond"))
    deep = pairs.join(words.where(~few), "code").groupBy("chunk").agg(F.min_by(ratio, "cut").alias("deep"))
    short = written(words.where(few), "tox-short")  # SHORT rows at most
    root = short.where("code = 0").first()
    out = codes.join(deep.withColumnRenamed("chunk", "code"), "code", "left").withColumn("size", F.ceil(F.length(F.bin("code")) / 8).cast("int"))
    for size in (1, 2):
        known = short.select(F.col("code").alias("start"), F.col("whole").alias(f"whole{size}"), F.col("beyond").alias(f"beyond{size}"))
        start = F.when(F.col("size") >= size, F.expr(f"shiftrightunsigned(code, 8 * (size - {size}))"))
        out = out.withColumn("start", start).join(F.broadcast(known), "start", "left").drop("start")
    two, one = (F.when(F.col("size") == size, F.col(f"whole{size}")).otherwise(F.col(f"beyond{size}")) for size in (2, 1))
    return out.select("code", F.coalesce("deep", two, one, F.lit(root["beyond"] if root else 0.0)).alias("ratio"))


def split_chunks(docs: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """`docs` with tox_row, tox_units (its chunks) and tox_split instead of the text.  One row of each split has its chunks:
    codes in order, and for each of its rows the number of distinct ones, their steps in that order and their counts."""
    columns = ["codes", "sizes", "steps", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = row = TaskContext.get().partitionId() << 40
        seen, sizes, at, times, last, held = [], [], [], [], None, 0

        def closed() -> dict[str, bytes]:
            codes = np.unique(np.concatenate(seen))
            at_all = np.concatenate([np.searchsorted(codes, found).astype(np.uint32)[a] for found, a in zip(seen, at, strict=True)])
            n = np.concatenate(sizes)
            steps = np.diff(at_all, prepend=np.uint32(0))
            first = (np.cumsum(n) - n)[n > 0]
            steps[first] = at_all[first]
            return {"codes": packed(np.diff(codes.view(np.int64), prepend=0)), "sizes": packed(n), "steps": packed(steps), "times": packed(np.concatenate(times))}

        def batch(piece: pa.RecordBatch, first: int, units: np.ndarray, chunks: dict[str, bytes] | None) -> pa.RecordBatch:
            n = piece.num_rows
            data = [pa.array([chunks[c] if chunks else None] + [None] * (n - 1), pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in kept), pa.array(first + np.arange(n)), pa.array(units), pa.array(np.full(n, split)), *data],
                                              names=schema.names)

        for piece, terms in term_batches(batches):
            if last and held >= SPLIT:
                yield batch(*last, closed())
                split, last, held, seen, sizes, at, times = row, None, 0, [], [], [], []
            if last:
                yield batch(*last, None)
            code, text = chunks(terms)
            found, where = np.unique(code, return_inverse=True)
            pair, n = np.unique(text.astype(np.int64) << 32 | where, return_counts=True)  # each code of a text once
            seen.append(found)
            at.append((pair & 0xFFFFFFFF).astype(np.uint32))
            times.append(n.astype(np.uint32))
            sizes.append(np.bincount(pair >> 32, minlength=piece.num_rows).astype(np.uint32))
            last = piece, row, np.bincount(text, minlength=piece.num_rows).astype(np.int64)
            row, held = row + piece.num_rows, held + len(terms.data)
        if last:
            yield batch(*last, closed())

    added = [T.StructField(f"tox_{c}", T.LongType()) for c in ("row", "units", "split")] + [T.StructField(f"tox_{c}", T.BinaryType()) for c in columns]
    schema = T.StructType([*kept, *added])
    return docs.select(*[f.name for f in kept], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tox_split, code) of the distinct chunks of each split."""
    for batch in batches:
        for split, data in zip(batch.column("tox_split").to_pylist(), batch.column("tox_codes"), strict=True):
            codes = unpacked_keys(data.as_py())
            for lo in range(0, len(codes), 1 << 16):
                part = codes[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), split)), pa.array(part)], names=["tox_split", "code"])


def _split_sums(split: pa.Table, ratios: pa.Table) -> pa.Table:
    """(tox_row, tox_sum, tox_over) of a split's rows that have chunks, from (code, value) of all its chunks."""
    data = {c: split.column(f"tox_{c}")[0].as_py() for c in ("codes", "sizes", "steps", "times")}
    codes, sizes = unpacked_keys(data["codes"]).view(np.uint64), unpacked(data["sizes"], np.uint32).astype(np.int64)
    found, value = ratios.column("code").to_numpy().view(np.uint64), ratios.column("value").to_numpy().astype(np.int64)
    order = np.argsort(found)
    if not np.array_equal(found[order], codes):
        raise ValueError("a split's chunks and their log ratios differ")
    value, steps, n = value[order], unpacked(data["steps"], np.uint32).astype(np.int64), unpacked(data["times"], np.uint32).astype(np.int64)
    has = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[has]
    run = np.cumsum(steps)
    at = run - np.repeat(run[first] - steps[first], sizes[has])
    whole, over = (np.add.reduceat(n * v[at], first) for v in (value, np.maximum(value - int(MARGIN * UNIT), 0)))
    return pa.table({"tox_row": split.column("tox_split")[0].as_py() + has, "tox_sum": whole, "tox_over": over})


def evidence(docs: DataFrame, words: DataFrame) -> DataFrame:
    """`docs` (any columns and text) without the text, with tox_evidence and tox_ratio; words: (code, whole, beyond)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    rows = written(split_chunks(docs, kept), "tox-chunks", "zstd")
    splits = rows.where("tox_codes is not null and tox_times is not null").select("tox_split", "tox_codes", "tox_sizes", "tox_steps", "tox_times")
    codes = splits.select("tox_split", "tox_codes").mapInArrow(_spelled, "tox_split long, code long")
    ratios = written(chunk_ratios(codes.select("code").distinct(), words).select("code", F.round(F.col("ratio") * UNIT).cast("int").alias("value")), "tox-ratios", "zstd")
    each = codes.join(ratios, "code").select("tox_split", "code", "value")
    sums = splits.groupBy("tox_split").cogroup(each.groupBy("tox_split")).applyInArrow(_split_sums, "tox_row long, tox_sum long, tox_over long")
    out = rows.select(*[f.name for f in kept], "tox_row", "tox_units").join(sums, "tox_row", "left")

    over, whole = (F.coalesce(F.col(c) / UNIT, F.lit(0.0)) for c in ("tox_over", "tox_sum"))
    length = F.col("tox_units") + LENGTH
    return out.select(*[f.name for f in kept], (over / F.sqrt(length)).alias("tox_evidence"), (whole / length).alias("tox_ratio"))


def logistic(scored: DataFrame) -> tuple[float, float, float]:
    """Intercept and slopes of the toxic share by evidence and log ratio, from (kind, tox_evidence, tox_ratio) in bins; the two
    pseudo-counts at either end keep them finite when these tell the classes apart."""
    evidence_bin = F.least(F.floor(F.col("tox_evidence") / BIN), F.lit(BINS - 1))
    ratio_bin = F.greatest(F.least(F.floor(F.col("tox_ratio") / RATIO_BIN), F.lit(RATIO_BINS - 1)), F.lit(-RATIO_BINS))
    bins = sorted(scored.groupBy(evidence_bin.alias("bin"), ratio_bin.alias("ratio")).agg(
        F.sum((F.col("kind") >= 2).cast("long")).alias("bad"), F.count("*").alias("n")).collect())  # BINS * 2 * RATIO_BINS rows at most
    x = np.array([[1.0, (r["bin"] + 0.5) * BIN, (r["ratio"] + 0.5) * RATIO_BIN] for r in bins] + [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, BIN * BINS / 8, RATIO_BIN * RATIO_BINS / 8]])
    n = np.array([r["n"] for r in bins] + [1.0, 0.0, 1.0])
    bad = np.array([r["bad"] for r in bins] + [0.0, 0.0, 1.0])
    b, ridge = np.zeros(3), np.array([0.0, 1e-3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = x.T @ (bad - n * p) - ridge * b
        free = np.array([True, b[1] > 0 or gradient[1] > 0, True])  # the slope of evidence stays 0 where it would fall below
        curve = (x * w[:, None]).T @ x + np.diag(ridge)
        step = np.zeros(3)
        step[free] = np.clip(np.linalg.solve(curve[np.ix_(free, free)], gradient[free]), -2, 2)
        then = b + step
        then[1] = max(then[1], 0.0)
        b, moved = then, np.abs(then - b).max()
        if moved < 1e-9:
            break
    return float(b[0]), float(b[1]), float(b[2])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted, evidence, log_ratio."""
    texts = labelled(docs, labels)
    rows = docs.select("doc_id", "text")
    classes = {r["bad"]: r["n"] for r in texts.groupBy((F.col("kind") >= 2).alias("bad")).agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        out = rows.select("doc_id", F.lit(0.0).alias("tox_evidence"), F.lit(0.0).alias("tox_ratio"))
        score = F.lit(1.0 if True in classes else 0.0)
    else:
        words = lexicon(node_counts(texts))
        a, b, c = logistic(evidence(texts.where("kind % 2 = 1"), words.where("model = 0").drop("model")))
        out = evidence(rows, words.where("model = 1").drop("model"))
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("tox_evidence") + F.lit(c) * F.col("tox_ratio"))))
    out = out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"), F.col("tox_evidence").alias("evidence"), F.col("tox_ratio").alias("log_ratio"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "log_ratio")
