"""Ordered operations without a single-task window.

A window `partitionBy(label).orderBy(u)` puts a whole class in one task; a
window with no partition puts the whole table there.  Every ordered operator
here instead:

1. assigns each row a *bucket* that is monotone in the sort key (a uniform
   hash slice, or the range partition of the key),
2. aggregates per (group, bucket) - a table of at most groups x B rows,
3. prefix-sums that small table to get each bucket's offset,
4. runs the window *inside* (group, bucket) and adds the offset.

Task size is then n / B, and B grows with the data (`choose_buckets`), without
an upper limit: range partitions are found by sampling the key, so no expression
grows with B, and joins are on the bucket even where there is no group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.session import cut_lineage

ROWS_PER_BUCKET = 500_000


def choose_buckets(n_rows: int, rows_per_bucket: int | None = None) -> int:
    return max(1, math.ceil(max(n_rows, 1) / (rows_per_bucket or ROWS_PER_BUCKET)))


def _offsets(df: DataFrame, group_cols: Sequence[str], bucket: str, measures: dict[str, Column],
             descending: bool) -> DataFrame:
    """Per (group, bucket): sum of each measure in all *earlier* buckets."""
    tot = df.groupBy(*group_cols, bucket).agg(*[F.sum(m).alias(f"_t_{k}") for k, m in measures.items()])
    order = F.col(bucket).desc() if descending else F.col(bucket).asc()
    w = Window.partitionBy(*group_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tot.select(*group_cols, bucket,
                      *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in measures])


def uniform_bucket(u: Column | str, n_buckets: int) -> Column:
    u = F.col(u) if isinstance(u, str) else u
    return F.least(F.floor(u * n_buckets), F.lit(n_buckets - 1)).cast("int")


def rank_in_groups(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   bucket: Column, rank_col: str = "rank") -> DataFrame:
    """1-based rank within `group_cols` by `order_cols` (ascending).

    `bucket` must be non-decreasing in the order (e.g. `uniform_bucket(u, B)`
    when ordering by u).  Output keeps all input columns plus `rank_col`.
    """
    b = "_bucket"
    with_b = df.withColumn(b, bucket)
    offs = _offsets(with_b, group_cols, b, {"n": F.lit(1)}, descending=False)
    w = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
    joined = with_b.join(offs, [*group_cols, b])
    return (joined.withColumn(rank_col, F.col("_o_n") + F.row_number().over(w))
                  .drop(b, "_o_n"))


def range_buckets(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], n_buckets: int | None) -> DataFrame:
    """`df` with `_bucket`, the range partition of (group, order) a row falls in.

    Written to the checkpoint folder: a partition's number holds only for the
    run that dealt it.
    """
    n = n_buckets or choose_buckets(df.count())
    dealt = df.repartitionByRange(n, *[F.col(c) for c in group_cols], *order)
    return cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))


def running_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, measures: Sequence[str],
                 descending: bool = True, n_buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of `measures` in `order_col` order, per group.

    Rows must be unique per (group, order_col) - callers aggregate to distinct
    scores first, so ties in the raw data cannot skew a task.
    """
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    with_b = range_buckets(df, group_cols, [order], n_buckets)
    offs = _offsets(with_b, group_cols, "_bucket", {m: F.col(m) for m in measures}, descending=False)
    w = (Window.partitionBy(*group_cols, "_bucket").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = with_b.join(offs, [*group_cols, "_bucket"])
    for m in measures:
        out = out.withColumn(f"{prefix}{m}", F.col(f"_o_{m}") + F.sum(m).over(w))
    return out.drop("_bucket", *[f"_o_{m}" for m in measures])


def with_totals(df: DataFrame, source: DataFrame, group_cols: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """`df` with the sums over `source` of columns, {new name: column}: joined by
    group, or as literals where there is none."""
    aggs = [F.sum(c).alias(k) for k, c in totals.items()]
    if group_cols:
        return df.join(source.groupBy(*group_cols).agg(*aggs), list(group_cols))
    row = source.agg(*aggs).first()
    return df.withColumns({k: F.lit(row[k]) for k in totals})


#: Accuracy of the sketch that brackets a quantile; groups of up to SMALL_GROUP rows are bracketed by their ends; distinct
#: bracketed values that one window per group takes.
ACCURACY, SMALL_GROUP, BRACKETED = 10_000, 20_000, 1_000_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), n_buckets: int | None = None,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default) per group, by selection.

    A first scan sketches each group: values that surely lie on either side of
    every quantile, as a sketch's rank error is at most 1 / ACCURACY.  A second
    one counts the rows below each bracket, and the distinct values inside it,
    some 4 / ACCURACY of the rows; the values of the wanted ranks are among these.
    So no value outside of a bracket is shuffled, and one that a third of the rows
    hold is one row.  Output: group columns + one column per prob (named `names`
    or q<pct>) + `n`.
    """
    names, groups = list(names or [f"q{int(round(p * 100))}" for p in probs]), list(group_cols)
    rows = df.where(F.col(value).isNotNull()).select(*(groups or [F.lit(0).alias("_all")]), F.col(value).alias("_value"))
    groups = groups or ["_all"]
    slack = 2.0 / ACCURACY
    ends = [end for p in probs for end in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("_min"), F.max("_value").alias("_max"),
                                       F.percentile_approx("_value", ends, F.lit(ACCURACY)).alias("_ends"))
    few = F.col("n") <= SMALL_GROUP
    brackets = cut_lineage(sketch.select(*groups, "n", F.array(*[F.struct(
        F.when(few, F.col("_min")).otherwise(F.col("_ends")[2 * i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_ends")[2 * i + 1]).alias("hi"))
        for i in range(len(probs))]).alias("_brackets")))  # one row a group
    near = rows.join(brackets, groups)
    place = F.when(F.col("_value") < F.col("b.lo"), F.lit(None)).otherwise(F.col("_value"))
    each = near.select(*groups, F.posexplode("_brackets").alias("_q", "b"), "_value").where(F.col("_value") <= F.col("b.hi"))
    counts = cut_lineage(each.groupBy(*groups, "_q", place.alias("_value")).agg(F.count(F.lit(1)).alias("_cnt")))  # null: below the bracket
    inside = counts.where(F.col("_value").isNotNull())
    below = counts.where(F.col("_value").isNull()).select(*groups, "_q", F.col("_cnt").alias("_below"))
    if inside.count() <= BRACKETED:
        w = Window.partitionBy(*groups, "_q").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = inside.withColumn("cum__cnt", F.sum("_cnt").over(w))
    else:
        cum = running_sums(inside, [*groups, "_q"], "_value", ["_cnt"], descending=False, n_buckets=n_buckets)
    cum = cum.join(below, [*groups, "_q"], "left")
    cum = cum.join(brackets.drop("_brackets"), groups)
    # a value covers 0-based positions [start, end]
    end = F.coalesce("_below", F.lit(0)) + F.col("cum__cnt") - 1
    start = end - F.col("_cnt") + 1
    h = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_q") + 1)
    lo, hi = F.floor(h), F.ceil(h)
    picked = cum.groupBy(*groups, "n", "_q").agg(
        F.max(F.when((start <= lo) & (lo <= end), F.col("_value"))).alias("_lo"),
        F.max(F.when((start <= hi) & (hi <= end), F.col("_value"))).alias("_hi"), F.first(h - lo).alias("_part"))
    picked = picked.withColumn("_quantile", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    out = picked.groupBy(*groups, "n").agg(*[F.max(F.when(F.col("_q") == i, F.col("_quantile"))).alias(name) for i, name in enumerate(names)])
    return out.drop("_all")


def rank_by_value(df: DataFrame, group_cols: Sequence[str], value: str, tiebreak: Sequence[str] = (),
                  n_buckets: int | None = None, rank_col: str = "rank") -> DataFrame:
    """1-based rank by an arbitrary sortable column, bucketed by its ranges."""
    dealt = range_buckets(df, group_cols, [F.col(value), *map(F.col, tiebreak)], n_buckets).withColumnRenamed("_bucket", "_vb")
    return rank_in_groups(dealt, group_cols, [value, *tiebreak], F.col("_vb"), rank_col).drop("_vb")
