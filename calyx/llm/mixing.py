"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / q, with u from a hash of its
id and q its quality weight; ascending keys order the documents of a source.  A
source's target is met by whole epochs (every document once each) and then a
fractional selection: documents in key order until the running word count comes
nearest to what is left, so a source misses its target by at most half a
document.  Targets share `share` x all words by weight, never above `cap` x the
source's own words; the excess is shared out anew (water filling, closed form).

A source may hold a third of all rows, so no task sorts a whole source.  Keys
fall into bins of about BIN_ROWS rows; word counts per (source, bin) find the
bin in which the target is reached, and only the rows of that bin are ranked.

Null ids and repeated rows take part as rows of their own (rows alike in every
column are interchangeable).  A null text has size 0.  A null source is a source
of its own, last in order.  Sources without words have target 0 and take nothing.
An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import set_aside, word_count, written

SEED = "mix-1"
#: Quality weight of a document by its mean word length in characters: inside the range 1, else LOW_QUALITY.
WORD_LENGTH = (3, 10)
LOW_QUALITY = 0.25
BIN_ROWS = 10_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = SEED) -> DataFrame:
    """Per row: doc_id, source, row_hash (of all columns), size, sort_key, spread (the key mapped to [0, 1))."""
    text = F.col(text_col).cast("string")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), 1, 13), 16, 10)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(*docs.columns).alias("row_hash"),
        word_count(text).alias("size"), F.length(text).alias("chars"),
        ((draw.cast("bigint") + 0.5) / float(1 << 52)).alias("u"))
    good = F.col("chars").between(WORD_LENGTH[0] * F.col("size"), WORD_LENGTH[1] * F.col("size"))
    rows = rows.withColumn("sort_key", -F.log("u") / F.when(good, 1.0).otherwise(LOW_QUALITY))
    return rows.select("doc_id", "source", "row_hash", "size", "sort_key",
                       (1 - F.exp(-F.col("sort_key") * LOW_QUALITY)).alias("spread"))


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source: source, source_size, target.  The table has one row for each source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sizes = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    # Rising cap / weight is the order in which sources fill up while the common level rises.
    filling = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes
             .withColumn("total", F.sum("source_size").over(everything))
             .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
             .withColumn("used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap)))
             .withColumn("at", (F.col("total") * float(share) - F.col("used")) / F.col("weight_left"))
             .withColumn("open", F.col("source_size") * float(cap) > F.col("at") * F.col("weight"))
             .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"),
                                                                       "weight_left", "at"))).over(everything)["at"]))
    full = F.col("source_size") * float(cap)
    return sizes.select("source", "source_size",
                        F.when(F.col("level").isNull(), full)
                        .otherwise(F.least(full, F.col("level") * F.col("weight"))).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, **named: str) -> DataFrame:
    """Per row of `docs`: doc_id, source, row_hash, size, source_size, target, copies (0 up to ceil(cap)), taken (words)."""
    rows = written(sized(docs, **named), "mix-sizes")
    bins = max(64, -(-rows.count() // BIN_ROWS))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("spread") * bins), F.lit(bins - 1)))
    target = source_targets(rows, weights, share, cap)
    target = (target.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
              .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    target = written(target, "mix-targets")

    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    binned = binned.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "bin_source")
    cut = (binned.join(target.select("source", "rest"), F.col("bin_source").eqNullSafe(F.col("source")))
           .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
           .groupBy("bin_source").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("words")).alias("within"))).alias("cut")))
    cuts = (target.join(cut, F.col("source").eqNullSafe(F.col("bin_source")), "left")
            .select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest",
                    F.col("cut.bin").alias("cut_bin"), F.col("cut.within").alias("within")))
    cuts = written(cuts, "mix-cuts")

    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    ranked = Window.partitionBy("source").orderBy("sort_key", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = (rows.where(F.col("bin") == F.col("cut_bin"))
            .withColumn("running", F.sum("size").over(ranked) - F.col("size"))
            .withColumn("extra", (F.col("running") + F.col("size") / 2 <= F.col("within")).cast("int")).drop("running"))
    # Without a cut bin the running sum never reaches the rest (a rounding of the target): every row is taken once more.
    clear = (rows.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
             .withColumn("extra", ((F.col("rest") > 0) & F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(True))).cast("int")))
    both = edge.unionByName(clear).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int"))
    return both.select("doc_id", "source", "row_hash", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken."""
    taken = mix(docs, weights, share, cap).where("copies > 0").groupBy("row_hash").agg(F.sum("copies").cast("int").alias("mix_copies"))
    plain = set_aside(docs)
    named = plain.withColumn("mix_row_hash", F.xxhash64(*plain.columns)).dropDuplicates(["mix_row_hash"])
    return (named.join(taken.withColumnRenamed("row_hash", "mix_row_hash"), "mix_row_hash")
            .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
            .select(*plain.columns).toDF(*docs.columns))
