"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has one set of byte 5-grams for each language, counted over all
trusted documents, and one over all languages together for documents without a
language or in one that has no trusted text.  Counts, contexts and lower orders
are sharded by context and joined there with the documents' distinct n-grams
(gram_shards):

    p5(e|abcd) = max(n(abcde) - D, 0) / n(abcd.) + g(abcd) p4(e|bcd)

with p4 to p1 alike over the numbers of distinct preceding bytes, p0 = 1/256,
and three discounts per order and language from the counts of counts.  A byte of
a document in a language costs -ln(OWN p(language) + (1 - OWN) p(all)): what a
text says in another trusted language is no sign of junk.

A document's score is its negative log probability over (bytes + PRIOR_BYTES),
so that a few bytes can't condemn it.  It is rejected when its score exceeds the
QUANTILE of the trusted documents' scores in its language.  Each trusted
document is scored for that by a model of the other FOLDS - 1 folds of trusted
texts (folds by text hash, so copies share one): a model gives the text it was
trained on better scores than any other.

judge, quality_scores and good_documents score by these.  A single model of byte
trigrams (train, train_folds) is a table of its own, which with_cost, with_worst
and with_scores send to all tasks up to TABLE_ROWS contexts; cost_by_joins joins it.

Toxic text reads like clean text but for a few words, so a second such model, of
the documents labelled toxic, is held against the trusted one: a document is
toxic when the WINDOW bytes that speak most for it, by the sum of ln p(toxic) -
ln p(trusted), exceed the same quantile of the same held-out trusted documents.

Null texts count as empty; texts without bytes have score 0 and are kept.
Without trusted texts in two folds no document is rejected.  Rows with a null id and
repeated rows are scored like others; a label row with a null id is ignored, and
an id with several labels is trusted if all of them are, and toxic if any is.
Without toxic labels no document is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx.llm import gram_shards
from calyx.llm.common import row_slices, set_aside, written

PRIOR_BYTES = 100
QUANTILE = 0.99
#: At most 9: a fold is one character of a key.
FOLDS = 4
#: Bytes over which the toxic model is held against the trusted one: about two words.
WINDOW = 16
#: Weight of the document's own language beside that of all languages together.
OWN = 0.5
#: Dense rows (1 KB each) of a model that is sent to every task.
TABLE_ROWS = 60_000
SLICE = 1 << 19
POOLED = "*"


def language(lang: Column) -> Column:
    return F.when(lang.isNotNull(), F.concat(F.lit("l:"), lang.cast("string"))).otherwise(F.lit(POOLED))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled of good quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return (labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
            .where("good").select("doc_id"))


def toxic_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled toxic."""
    return labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ending in each byte (texts begin with two zero bytes) and where each text begins."""
    data = np.frombuffer(b"".join(b"\0\0" + t for t in texts), np.uint8).astype(np.int32)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.r_[0, np.cumsum(size + 2)][:-1]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    code = np.zeros(len(data), np.int32)
    code[2:] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    real = np.ones(len(data), bool)
    real[start], real[start + 1] = False, False
    return code[real], np.r_[0, np.cumsum(size)][:-1]


def _by_language(piece: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, rows, texts) of a record batch with lang and text."""
    langs = np.array(piece.column("lang").to_pylist(), object)
    texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        yield lang, rows, [texts[r] for r in rows]


def _give_back() -> None:
    """Unused Arrow memory to the system: workers wait for the next stage's tasks with what they hold."""
    pa.default_memory_pool().release_unused()


# ---- counts and model -------------------------------------------------------

def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over `docs` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, "text", SLICE):
                for lang, _, texts in _by_language(piece):
                    code, n = np.unique(_codes(texts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()),
                                                      pa.array(n.astype(np.int64))], names=["lang", "code", "n"])
            _give_back()

    each = docs.select("lang", "text").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return written(each, "kn-counts")


def with_pooled(each: DataFrame, *keys: str) -> DataFrame:
    """Counts (keys, lang, code, n) of each language, and of all together."""
    pooled = each.groupBy(*keys, "code").agg(F.sum("n").alias("n")).select(*keys, F.lit(POOLED).alias("lang"), "code", "n")
    return each.where(F.col("lang") != POOLED).unionByName(pooled)


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def _order(counts: DataFrame, lower: DataFrame | None, mask: int) -> tuple[DataFrame, DataFrame]:
    """One order of the model from counts (lang, code, n): probabilities (lang, code, p) of what was seen, and back-off
    weights (lang, ctx, g).  lower: probabilities of the next lower order, by code & mask; None: uniform over bytes."""
    rows = counts.withColumn("ctx", F.shiftright("code", 8))
    n = F.col("n")
    kinds = rows.groupBy("lang").agg(*[F.sum((n == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def discount(k: int) -> Column:
        usual = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when(usual.between(0.05, k - 0.05), usual).otherwise(F.lit(k / 2)).alias(f"d{k}")

    kinds = kinds.select("lang", *[discount(k) for k in (1, 2, 3)])
    contexts = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), *[
        F.sum((F.least(n, F.lit(3)) == k).cast("long")).alias(f"c{k}") for k in (1, 2, 3)])
    back = contexts.join(kinds, "lang").select(
        "lang", "ctx", "total", "d1", "d2", "d3",
        (sum((F.col(f"d{k}") * F.col(f"c{k}") for k in (2, 3)), F.col("d1") * F.col("c1")) / F.col("total")).alias("g"))
    cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.join(back, ["lang", "ctx"])
    if lower is None:
        rows = rows.withColumn("under", F.lit(1 / 256))
    else:
        rows = rows.withColumn("low", F.col("code").bitwiseAND(F.lit(mask))).join(
            lower.select("lang", F.col("code").alias("low"), F.col("p").alias("under")), ["lang", "low"])
    return rows.select("lang", "code", ((n - cut) / F.col("total") + F.col("g") * F.col("under")).alias("p")), back.select("lang", "ctx", "g")


def train(docs: DataFrame) -> DataFrame:
    """Model of `docs` (lang, text) as a table (lang, kind, code, value): p3, p2, p1 of what was seen, g3, g2, g1 back-off weights."""
    return fitted(written(with_pooled(trigram_counts(docs)), "kn-counts-all"))


def train_folds(docs: DataFrame, toxic: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Models of `docs` (lang, text) without each fold, then that of all; and that of `toxic`: counted once, fitted as
    languages of one table."""
    part = docs.select(fold(F.col("text")).cast("string").alias("fold"), "lang", "text").unionByName(toxic.select(F.lit("t").alias("fold"), "lang", "text"))
    each = trigram_counts(part.select(F.concat("fold", F.lit("/"), "lang").alias("lang"), "text"))
    each = each.select(F.substring("lang", 1, 1).alias("fold"), F.expr("substring(lang, 3)").alias("lang"), "code", "n")
    outs = F.filter(F.array(*[F.lit(str(out)) for out in range(FOLDS + 1)]), lambda out: out != F.col("fold"))
    each = each.select("*", F.explode(F.when(F.col("fold") == "t", F.array(F.lit("t"))).otherwise(outs)).alias("out"))
    sums = with_pooled(each.groupBy("out", "lang", "code").agg(F.sum("n").alias("n")), "out")
    model = fitted(written(sums.select(F.concat("out", F.lit("/"), "lang").alias("lang"), "code", "n"), "kn-counts-all"))
    models = [model.where(F.col("lang").startswith(f"{out}/")).withColumn("lang", F.expr("substring(lang, 3)")) for out in (*range(FOLDS + 1), "t")]
    return models[:-1], models[-1]


def fitted(three: DataFrame) -> DataFrame:
    """As train, from its counts (lang, code, n)."""
    two = three.groupBy("lang", F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.count("*").alias("n"))
    two = written(two, "kn-two")
    one = written(two.groupBy("lang", F.col("code").bitwiseAND(F.lit(0xFF)).alias("code")).agg(F.count("*").alias("n")), "kn-one")
    tables, lower = [], None
    for name, counts, mask in (("1", one, 0), ("2", two, 0xFF), ("3", three, 0xFFFF)):
        p, g = _order(counts, lower, mask)
        p = written(p, f"kn-p{name}")
        tables += [p.select("lang", F.lit(f"p{name}").alias("kind"), "code", F.col("p").alias("value")),
                   g.select("lang", F.lit(f"g{name}").alias("kind"), F.col("ctx").alias("code"), F.col("g").alias("value"))]
        lower = p
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return written(whole, "kn-model")


def dense(model: DataFrame, bounded: bool = True) -> dict[str, tuple[np.ndarray, np.ndarray]] | None:
    """Per language: row number of each context, and p by (row, byte); None if that takes over TABLE_ROWS rows and is bounded."""
    if bounded and model.where("kind = 'g3'").count() + 256 * model.select("lang").distinct().count() > TABLE_ROWS:
        return None
    held = model.toArrow()
    langs, kinds = (np.array(held.column(c).to_pylist(), object) for c in ("lang", "kind"))
    codes, values = (held.column(c).to_numpy() for c in ("code", "value"))
    out = {}
    for lang in sorted(set(langs)):
        of = {k: (codes[m], values[m]) for k in ("p1", "p2", "p3", "g1", "g2", "g3") for m in [(langs == lang) & (kinds == k)]}
        p1 = np.full(256, of["g1"][1][0] / 256)
        p1[of["p1"][0]] = of["p1"][1]
        p2 = np.tile(p1, (256, 1))
        p2[of["g2"][0]] *= of["g2"][1][:, None]
        p2[of["p2"][0] >> 8, of["p2"][0] & 255] = of["p2"][1]
        contexts, weights = of["g3"]
        rows = np.tile(len(contexts) + np.arange(256, dtype=np.int32), 256)
        rows[contexts] = np.arange(len(contexts))
        p3 = p2[contexts & 255] * weights[:, None]
        p3[rows[of["p3"][0] >> 8], of["p3"][0] & 255] = of["p3"][1]
        out[lang] = rows, np.concatenate([p3, p2]).astype(np.float32)
    return out


def byte_costs(models: dict[str, tuple[np.ndarray, np.ndarray]], lang: str, code: np.ndarray) -> np.ndarray:
    """-ln p of the last byte of each trigram, in a document whose model is that of `lang`."""

    def chance(of: str) -> np.ndarray:
        place, value = models[of]
        return value.ravel()[place[code >> 8].astype(np.int64) * 256 + (code & 255)].astype(np.float64)

    return -np.log(chance(lang) if lang == POOLED else OWN * chance(lang) + (1 - OWN) * chance(POOLED))


# ---- scores -----------------------------------------------------------------

def sent(model: DataFrame) -> Broadcast | None:
    """The dense model as sent to tasks; it lies on every executor's disk until destroyed.  None if it is too large."""
    table = dense(model)
    return None if table is None else model.sparkSession.sparkContext.broadcast(table)


def with_cost(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang", shared: Broadcast | None = None) -> DataFrame:
    """`docs` with lm_lang (whose model is used), lm_bytes and lm_cost (-ln p of the text; null without a model).
    shared: the model, if it has been sent already.  Columns of `docs` of these names are replaced."""
    docs = docs.drop("lm_lang", "lm_bytes", "lm_cost")
    shared = shared or sent(model)
    if shared is None:
        return cost_by_joins(docs, model, text_col, lang_col)
    rows, source = _with_text(docs.withColumn("lm_lang", language(F.col(lang_col))), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for piece in row_slices(batch, source, SLICE):
                own = [x if x in models else POOLED for x in piece.column("lm_lang").to_pylist()]
                work = pa.RecordBatch.from_arrays([pa.array(own, pa.string()), piece.column(source)], names=["lang", "text"])
                cost = np.full(len(own), np.nan)
                size = np.zeros(len(own), np.int64)
                for lang, at, texts in _by_language(work):
                    size[at] = [len(t) for t in texts]
                    if lang not in models:
                        continue
                    code, start = _codes(texts)
                    total = np.r_[0.0, np.cumsum(byte_costs(models, lang, code))]
                    cost[at] = total[start + size[at]] - total[start]
                left = piece.schema.names
                arrays = [piece.column(c) for c in left if c not in ("lm_lang", "lm_text")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(own, pa.string()), pa.array(size), pa.array(cost, from_pandas=True)],
                                                 names=[*(c for c in left if c not in ("lm_lang", "lm_text")), "lm_lang", "lm_bytes", "lm_cost"])
            _give_back()

    schema = docs.select("*", F.lit("").alias("lm_lang"), F.lit(0).cast("long").alias("lm_bytes"), F.lit(0.0).alias("lm_cost")).schema
    for field in schema.fields[-3:]:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def _with_text(rows: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """Rows and the name of their text as a string: text that is one already doesn't go to the tasks twice."""
    if rows.schema[text_col].dataType.simpleString() == "string":
        return rows, text_col
    return rows.withColumn("lm_text", F.col(text_col).cast("string")), "lm_text"


def cost_by_joins(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """As with_cost, for a model of any size: distinct trigrams of each document joined with the model's shards."""
    docs = docs.drop("lm_lang", "lm_bytes", "lm_cost")
    known = model.select(F.col("lang").alias("lm_lang")).distinct()
    key = F.xxhash64(*docs.columns)
    rows = docs.withColumn("lm_key", key).withColumn("lm_named", language(F.col(lang_col)))
    rows = rows.join(known, F.col("lm_named") == F.col("lm_lang"), "left").withColumn("lm_lang", F.coalesce("lm_lang", F.lit(POOLED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, "text", SLICE):
                for row, lang, text in zip(*(piece.column(c).to_pylist() for c in ("lm_key", "lm_lang")),
                                           piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    code, n = np.unique(_codes([text or b""])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(code), pa.int64()), pa.array([lang] * len(code), pa.string()),
                                                      pa.array(code, pa.int32()), pa.array(n.astype(np.int64))], names=["lm_key", "lang", "code", "n"])

    texts = rows.select("lm_key", "lm_lang", F.col(text_col).cast("string").alias("text")).dropDuplicates(["lm_key"])
    grams = texts.mapInArrow(run, "lm_key long, lang string, code int, n long")
    at = {"p3": F.col("code"), "g3": F.shiftright("code", 8), "p2": F.col("code").bitwiseAND(F.lit(0xFFFF)),
          "g2": F.shiftright("code", 8).bitwiseAND(F.lit(0xFF)), "p1": F.col("code").bitwiseAND(F.lit(0xFF)), "g1": F.lit(0)}

    def chance(rows: DataFrame, of: Column, name: str) -> DataFrame:
        """`rows` with the probability of each trigram's last byte under the model of language `of`."""
        rows = rows.withColumn("of", of)
        for k, code in at.items():
            shard = model.where(F.col("kind") == k).select(F.col("lang").alias("of"), F.col("code").alias(f"at_{k}"), F.col("value").alias(k))
            rows = rows.withColumn(f"at_{k}", code.cast("int")).join(shard, ["of", f"at_{k}"], "left")
        two = F.coalesce("p2", F.coalesce("g2", F.lit(1.0)) * F.coalesce("p1", F.col("g1") / 256))
        return rows.select("lm_key", "lang", "code", "n", *[c for c in rows.columns if c.startswith("chance_")],
                           F.coalesce("p3", F.coalesce("g3", F.lit(1.0)) * two).alias(name))

    grams = chance(chance(grams, F.col("lang"), "chance_own"), F.lit(POOLED), "chance_all")
    cost = grams.groupBy("lm_key").agg(F.sum(-F.log(OWN * F.col("chance_own") + (1 - OWN) * F.col("chance_all")) * F.col("n")).alias("lm_sum"))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    empty = model.limit(1).count() == 0
    whole = rows.join(cost, "lm_key", "left")
    value = F.lit(None).cast("double") if empty else F.when(size == 0, F.lit(0.0)).otherwise(F.col("lm_sum"))
    return whole.select(*docs.columns, "lm_lang", size.alias("lm_bytes"), value.alias("lm_cost"))


def with_worst(docs: DataFrame, model: DataFrame, toxic: DataFrame, text_col: str = "text", lang_col: str = "lang",
               shared: tuple[Broadcast | None, Broadcast | None] = (None, None)) -> DataFrame:
    """`docs` with lm_worst: the largest sum of ln p(toxic) - ln p(trusted) over WINDOW bytes in a row; null without bytes
    or a model.  Models over TABLE_ROWS are taken language by language, each with that of all languages."""
    docs = docs.drop("lm_worst")
    rows, source = _with_text(docs.withColumn("lm_named", language(F.col(lang_col))), text_col)
    trusted_sent, toxic_sent = (s or sent(m) for s, m in zip(shared, (model, toxic), strict=True))
    if trusted_sent is not None and toxic_sent is not None:
        return _worst(rows, docs, source, trusted_sent, toxic_sent)
    known = sorted(r[0] for r in model.select("lang").distinct().collect())  # one row a language
    rows = rows.withColumn("lm_named", F.when(F.col("lm_named").isin(known), F.col("lm_named")).otherwise(F.lit(POOLED)))
    whole = None
    for lang in sorted({*known, POOLED}):
        both = [docs.sparkSession.sparkContext.broadcast(dense(m.where(F.col("lang").isin(lang, POOLED)), bounded=False)) for m in (model, toxic)]
        part = _worst(rows.where(F.col("lm_named") == lang), docs, source, *both)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _worst_sums(ratio: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The largest sum of `ratio` over WINDOW bytes in a row, for each text that has bytes."""
    total, here = np.r_[0.0, np.cumsum(ratio)], np.arange(len(ratio))
    sums = total[1:] - total[np.maximum(np.repeat(start, size), here + 1 - WINDOW)]
    return np.maximum.reduceat(sums, start[size > 0])


def _worst(rows: DataFrame, docs: DataFrame, source: str, trusted: Broadcast, toxic: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, bad = trusted.value, toxic.value
        for batch in batches:
            for piece in row_slices(batch, source, SLICE):
                worst = np.full(piece.num_rows, np.nan)
                work = pa.RecordBatch.from_arrays([piece.column("lm_named"), piece.column(source)], names=["lang", "text"])
                for lang, at, texts in _by_language(work) if clean and bad else ():
                    size = np.array([len(t) for t in texts], np.int64)
                    code, start = _codes(texts)
                    if not len(code):
                        continue
                    ratio = byte_costs(clean, lang if lang in clean else POOLED, code) - byte_costs(bad, lang if lang in bad else POOLED, code)
                    worst[at[size > 0]] = _worst_sums(ratio, start, size)
                left = [c for c in piece.schema.names if c not in ("lm_named", "lm_text")]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in left), pa.array(worst, from_pandas=True)], names=[*left, "lm_worst"])
            _give_back()

    schema = docs.select("*", F.lit(0.0).alias("lm_worst")).schema
    schema.fields[-1].nullable = True
    return rows.mapInArrow(run, schema)


def with_scores(docs: DataFrame, model: DataFrame, toxic: DataFrame, text_col: str = "text", lang_col: str = "lang",
                shared: tuple[Broadcast | None, Broadcast | None] = (None, None)) -> DataFrame:
    """As with_worst after with_cost.  Models that are sent to tasks are held and applied by one worker a task: two in a
    row are two processes, each with a model of its own, which stay with the executor for a minute."""
    trusted_sent, toxic_sent = (s or sent(m) for s, m in zip(shared, (model, toxic), strict=True))
    if trusted_sent is None or toxic_sent is None:
        shared = trusted_sent, toxic_sent
        return with_worst(with_cost(docs, model, text_col, lang_col, trusted_sent), model, toxic, text_col, lang_col, shared)
    docs = docs.drop("lm_lang", "lm_bytes", "lm_cost", "lm_worst")
    rows, source = _with_text(docs.withColumn("lm_named", language(F.col(lang_col))), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, bad = trusted_sent.value, toxic_sent.value
        for batch in batches:
            for piece in row_slices(batch, source, SLICE):
                own = [x if x in clean else POOLED for x in piece.column("lm_named").to_pylist()]
                cost, worst = np.full(piece.num_rows, np.nan), np.full(piece.num_rows, np.nan)
                lengths = np.zeros(piece.num_rows, np.int64)
                work = pa.RecordBatch.from_arrays([piece.column("lm_named"), piece.column(source)], names=["lang", "text"])
                for named, at, texts in _by_language(work):
                    lengths[at] = size = np.array([len(t) for t in texts], np.int64)
                    lang = named if named in clean else POOLED
                    if lang not in clean:
                        continue
                    code, start = _codes(texts)
                    paid = byte_costs(clean, lang, code)
                    total = np.r_[0.0, np.cumsum(paid)]
                    cost[at] = total[start + size] - total[start]
                    if len(code) and bad:
                        worst[at[size > 0]] = _worst_sums(paid - byte_costs(bad, named if named in bad else POOLED, code), start, size)
                left = [c for c in piece.schema.names if c not in ("lm_named", "lm_text")]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in left), pa.array(own, pa.string()), pa.array(lengths), pa.array(cost, from_pandas=True),
                     pa.array(worst, from_pandas=True)], names=[*left, "lm_lang", "lm_bytes", "lm_cost", "lm_worst"])
            _give_back()

    added = {"lm_lang": F.lit(""), "lm_bytes": F.lit(0).cast("long"), "lm_cost": F.lit(0.0), "lm_worst": F.lit(0.0)}
    schema = docs.select("*", *[value.alias(name) for name, value in added.items()]).schema
    for field in schema.fields[-len(added):]:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def score() -> Column:
    return F.col("lm_cost") / (F.col("lm_bytes") + PRIOR_BYTES)


def thresholds(costs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lm_lang, lm_limit, lm_worst_limit): from held-out costs of trusted texts; documents without a language use those of all together."""
    good = costs.where("lm_cost is not null").withColumnRenamed("lang", "lm_lang")
    at = [F.percentile_approx(c, quantile, F.lit(100_000)).alias(name) for c, name in ((score(), "lm_limit"), (F.col("lm_worst"), "lm_worst_limit"))]
    each = good.groupBy("lm_lang").agg(*at)
    pooled = good.agg(*at).select(F.lit(POOLED).alias("lm_lang"), "lm_limit", "lm_worst_limit")
    return written(each.where(F.col("lm_lang") != POOLED).unionByName(pooled), "kn-limits")


def labelled_text(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, lang, text) of the trusted and of the toxic documents: lang as given and as a model's key.  The ids are
    hashed, the texts needn't be sorted, and are shuffled once for all folds."""
    ids = trusted_ids(labels).withColumn("toxic", F.lit(False)).unionByName(toxic_ids(labels).withColumn("toxic", F.lit(True)))
    rows = docs.select("doc_id", F.col("lang").alias("name"), language(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text"))
    both = rows.where("text is not null").join(written(ids, "kn-ids").hint("shuffle_hash"), "doc_id").drop("doc_id")
    both = written(both, "kn-text")
    return both.where("not toxic").drop("toxic"), both.where("toxic").drop("toxic")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, text: bool = True) -> DataFrame:
    """`docs` (without their text if text is False) with lm_bytes, lm_cost, lm_limit and lm_keep (not junk), lm_worst,
    lm_worst_limit and lm_clean (not toxic)."""
    body = F.col("text").cast("string")
    keys = {"lm_id": F.col("doc_id").cast("string"), "lm_named": language(F.col("lang")), "lm_fold": fold(body), "lm_text": body.cast("binary")}
    ids = trusted_ids(labels).withColumn("toxic", F.lit(False)).unionByName(toxic_ids(labels).withColumn("toxic", F.lit(True)))
    out = gram_shards.scored(docs, keys, ids.select(F.col("doc_id").cast("string").alias("lm_id"), "toxic"), text, FOLDS, WINDOW, OWN, POOLED)
    out = out.withColumn("text", F.col("lm_text").cast("string").cast(docs.schema["text"].dataType)) if text else written(out, "kn-scores")
    held_out = out.where("lm_trusted").select(F.col("lm_named").alias("lang"), "lm_bytes", F.col("lm_fold_cost").alias("lm_cost"),
                                              F.col("lm_fold_worst").alias("lm_worst"))
    out = out.join(F.broadcast(thresholds(held_out, quantile)), "lm_lang", "left").drop("lm_text", "lm_named", "lm_trusted", "lm_fold_cost", "lm_fold_worst")
    return out.withColumn("lm_keep", F.coalesce(score() <= F.col("lm_limit"), F.lit(True))).withColumn(
        "lm_clean", F.coalesce(F.col("lm_worst") <= F.col("lm_worst_limit"), F.lit(True)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, n_bytes, perplexity (per byte), score, limit, keep (not junk), toxic_score, toxic_limit,
    toxic_keep (not toxic)."""
    out = judge(docs.select("doc_id", "lang", "text"), labels, text=False)
    return out.select("doc_id", "lang", F.col("lm_bytes").alias("n_bytes"),
                      F.exp(F.col("lm_cost") / F.greatest("lm_bytes", F.lit(1))).alias("perplexity"),
                      score().alias("score"), F.col("lm_limit").alias("limit"), F.col("lm_keep").alias("keep"),
                      F.col("lm_worst").alias("toxic_score"), F.col("lm_worst_limit").alias("toxic_limit"), F.col("lm_clean").alias("toxic_keep"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` less junk and toxic ones: the decision is taken where the text is, so no text is shuffled for it."""
    plain = set_aside(docs, "doc_id", "lang", "text")
    return judge(plain, labels).where("lm_keep and lm_clean").select(*plain.columns).toDF(*docs.columns)
