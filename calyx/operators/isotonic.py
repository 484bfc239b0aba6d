"""Isotonic regression (F7) over any number of distinct inputs, per group.

Labels are summed per distinct x first.  The ranges of x are pooled on their own
(adjacent violators), then the pools of neighbouring ranges are merged FAN_IN at
a time until one range a group is left.  A pool whose mean is above all means to
its left and below all to its right can't take part in a further merge: it is
final at once and stays behind.  So what a later merge holds are only the pools
that still violate the order, not the points; nothing of that size reaches the
driver.

Rows with a null group, x or label take no part; neither does a NaN x.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.operators.ranking import choose_buckets, range_buckets
from calyx.session import cut_lineage

FAN_IN = 16


def pool_adjacent(points: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pools [lo, hi, total, weight] of strictly increasing mean from such points in order of x."""
    pools: list[list[float]] = []
    for lo, hi, total, weight in points:
        pools.append([lo, hi, total, weight])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, more, heavier = pools.pop()
            pools[-1][1] = last
            pools[-1][2] += more
            pools[-1][3] += heavier
    return pools


def _pooled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each range of `rows` (keys, _lo, _hi, _total, _weight) pooled on its own."""
    parts = ["_lo", "_hi", "_total", "_weight"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("_lo")
        pools = pd.DataFrame(pool_adjacent(ordered[parts].itertuples(index=False, name=None)), columns=parts)
        return pools.assign(**{k: frame[k].iloc[0] for k in keys})[[*keys, *parts]]

    rows = rows.select(*keys, *parts)
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def _mean() -> Column:
    return F.col("_total") / F.col("_weight")


def _points(df: DataFrame, x: str, label: str, groups: Sequence[str], rows_per_range: int | None) -> tuple[DataFrame, int]:
    """Distinct x of each group with the sum and number of its labels, in ranges of x (`_bucket`)."""
    value = F.col(x).cast("double")
    rows = df.select(*groups, value.alias("_lo"), F.col(label).cast("double").alias("_y")).dropna().where(~F.isnan("_lo"))
    points = rows.groupBy(*groups, "_lo").agg(F.sum("_y").alias("_total"), F.count(F.lit(1)).cast("double").alias("_weight"))
    ranges = choose_buckets(points.count(), rows_per_range)
    return range_buckets(points, groups, [F.col("_lo")], ranges), ranges


def _blocks(points: DataFrame, ranges: int, groups: Sequence[str]) -> DataFrame:
    keys = [*groups, "_bucket"]
    level = _pooled(points.withColumn("_hi", F.col("_lo")), keys)
    final = None
    while ranges > 1:
        level = cut_lineage(level)
        ends = level.groupBy(*keys).agg(F.min(_mean()).alias("_first"), F.max(_mean()).alias("_last"))  # one row a range
        order = Window.partitionBy(*groups).orderBy("_bucket")
        ends = ends.select(*keys, F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
                           F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
        clear = (F.coalesce(_mean() > F.col("_left"), F.lit(True)) & F.coalesce(_mean() < F.col("_right"), F.lit(True)))
        marked = level.join(ends, keys).withColumn("_clear", clear)
        done = marked.where("_clear").select(*level.columns)
        final = done if final is None else final.unionByName(done)
        left = marked.where("not _clear").withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("int"))
        ranges = -(-ranges // FAN_IN)
        level = _pooled(left, keys)
    return level if final is None else final.unionByName(level)


def isotonic_blocks(df: DataFrame, x: str = "score", label: str = "label", group_cols: Sequence[str] = (),
                    rows_per_range: int | None = None) -> DataFrame:
    """(groups, lo, hi, fitted, weight): the steps of the fit, each over the distinct x from lo to hi."""
    points, ranges = _points(df, x, label, group_cols, rows_per_range)
    return _blocks(points, ranges, group_cols).select(
        *group_cols, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), _mean().alias("fitted"), F.col("_weight").alias("weight"))


def isotonic_fitted(df: DataFrame, x: str = "score", label: str = "label", group_cols: Sequence[str] = (),
                    rows_per_range: int | None = None) -> DataFrame:
    """(groups, x, fitted) at the distinct x.

    The fit never falls, so the value at x is the largest mean of a step that
    starts at or before it: a running maximum inside x's range, and the maximum
    of the ranges before.
    """
    groups = list(group_cols)
    keys = [*groups, "_bucket"]
    points, ranges = _points(df, x, label, groups, rows_per_range)
    starts = cut_lineage(_blocks(points, ranges, groups).select(*groups, "_lo", _mean().alias("_mean")))
    rows = points.select(*keys, "_lo").join(starts, [*groups, "_lo"], "left")
    order = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys).agg(F.max("_mean").alias("_top")).select(*keys, F.max("_top").over(order).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitted = F.greatest(F.max("_mean").over(inside), F.col("_before"))
    return rows.join(before, keys).select(*groups, F.col("_lo").alias(x), fitted.alias("fitted"))
