"""Line dedup: a suffix array over line sequences, by distributed prefix doubling.

A text is cut at line feeds; its lines with at least one word form a sequence.
The suffixes that share their first d lines form an LCP interval of depth d,
named by its first suffix in (doc_id, text hash, place) order, so the name also
tells which copy is the earliest.  Depth 1 groups equal lines; an interval of
depth 2d is a pair of intervals of depth d, d places apart, so depths double
until `min_lines` is reached (the last step overlaps).  A suffix alone in its
interval can be in no deeper one and drops out, so each round handles only what
still repeats.

A run of lines is deleted if it repeats an earlier place: `min_lines` or more
lines in a row, or a single line of `long_line` words or more.  Intervals of
depth `min_lines` reach every maximal repeated run of that length, and covering
all their later copies covers the runs whole.  Earliest copies stay, as do lines
without words.

Lines are compared by 128-bit fingerprints.  Hot lines: intervals are counted
before the shuffle, and the join that returns their names can be split by Spark.
Null texts have no lines and stay null; empty texts stay.  Rows alike in id and
text are one place and are treated alike; a null id sorts first.  Further
columns are ignored and kept, whatever their names; those called line_total or
line_removed are replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import WORD, set_aside, written

MIN_LINES = 2
LONG_LINE = 8

#: named: whether there is an id; without one, doc_id is 0, as joins drop nulls.
DOC = ["named", "doc_id", "text_hash"]


def id_key(doc_id: Column) -> list[Column]:
    return [doc_id.isNotNull().alias("named"), F.coalesce(doc_id, F.lit(0)).alias("doc_id")]


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def line_sequence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with words: DOC, line (place in the text), place (in the sequence), key1, key2, words."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where("text is not null")
    lines = rows.select(*id_key(F.col("doc_id")), text_key(F.col("text")).alias("text_hash"), F.transform(
        F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("words_of"))).alias("all"))
    lines = lines.select(*DOC, F.posexplode(F.filter("all", lambda x: x["words_of"].rlike(WORD))).alias("place", "one"))
    body = F.col("one.words_of")
    return lines.select(*DOC, F.col("one.line").alias("line"), "place", F.xxhash64(body).alias("key1"),
                        F.xxhash64(F.lit("line"), body).alias("key2"), F.regexp_count(body, F.lit(WORD)).alias("words"))


def intervals(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` (DOC, place, ..., keys) that share their keys with another place, with `first`: the earliest such place."""
    place = F.struct(*[F.col(c) for c in DOC], F.col("place"))
    groups = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last_place"))
    groups = written(groups.where("first != last_place").drop("last_place"), f"lines-groups-{name}")
    return written(rows.join(groups, keys).drop(*keys), f"lines-{name}")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line) of the lines to delete."""
    sequence = written(line_sequence(docs, id_col, text_col), "lines-sequence")
    level = intervals(sequence.drop("line").distinct(), ["key1", "key2"], "1")
    here = F.struct(*[F.col(c) for c in DOC], F.col("place"))
    single = level.where((F.col("words") >= long_line) & (F.col("first") < here)).select(*DOC, "place")
    level, depth = level.select(*DOC, "place", "first"), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = level.select(*DOC, (F.col("place") - step).alias("place"), F.col("first").alias("then"))
        pairs = level.join(ahead, [*DOC, "place"])
        level = intervals(pairs.withColumnRenamed("first", "now"), ["now", "then"], str(depth + step))
        depth += step
    later = level.where(F.col("first") < here)
    covered = later.select(*DOC, F.explode(F.sequence("place", F.col("place") + (min_lines - 1))).alias("place"))
    gone = covered.unionByName(single).distinct()
    return sequence.select(*DOC, "place", "line").distinct().join(gone, [*DOC, "place"], "left_semi").select(
        F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "text_hash", "line")


def repeated_runs(docs: DataFrame, **settings) -> DataFrame:
    """Maximal runs of deleted lines: doc_id, text_hash, first_line, n_lines (consecutive lines of the text)."""
    by_line = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    runs = removed_lines(docs, **settings).withColumn("island", F.col("line") - F.row_number().over(by_line))
    return runs.groupBy("doc_id", "text_hash", "island").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines")).drop("island")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated lines cut from the text column, and two new columns, line_total and line_removed."""
    gone = removed_lines(docs, min_lines, long_line, id_col, text_col)
    gone = written(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone_lines")), "lines-gone")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone_lines")
    text = F.col(text_col).cast("string")
    new = ("line_total", "line_removed")
    plain = set_aside(docs.drop(*new), id_col, text_col)
    both = plain.withColumn("line_text_hash", text_key(text)).join(
        gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & (F.col("line_text_hash") == F.col("gone_hash")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone_lines", i)), "\n")
    columns = [F.when(F.col("gone_lines").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c).alias(name)
               for c, name in zip(plain.columns, docs.drop(*new).columns, strict=True)]

    def count(items: Column) -> Column:  # size(null) is -1 or null, by a session setting
        return F.when(items.isNull(), 0).otherwise(F.size(items)).cast("long")

    return both.select(*columns, count(F.split(text, "\n")).alias(new[0]), count(F.col("gone_lines")).alias(new[1]))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the kept text; null for a null text)."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("line_total")).cast("long").alias("n_lines"),
                       F.greatest("line_removed", F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
