"""Sinks (A3, A4): result tables and the nested run summary.

Writes go to a shared folder (callers pass paths under the cluster's shared
storage; tests use the session's checkpoint folder).  Output is written by the
executors in parallel; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def run_summary(spark: SparkSession, study: str, params: dict, dropped: Sequence[str],
                metrics: DataFrame) -> DataFrame:
    """One row: study name, params struct, dropped-feature list, and a struct of
    metric structs keyed by the metrics table's first column (e.g. split)."""
    key = metrics.columns[0]
    names = [c for c in metrics.columns if c != key]
    m = metrics.select(F.col(key).cast("string").alias("_k"), F.struct(*names).alias("_m"))
    by_key = m.agg(F.map_from_entries(F.collect_list(F.struct("_k", "_m"))).alias("metrics"))  # one entry per split
    p = F.struct(*[F.lit(v).alias(k) for k, v in params.items()]) if params else F.lit(None)
    dropped_arr = F.array(*[F.lit(d) for d in dropped]) if dropped else F.array().cast("array<string>")
    return by_key.select(F.lit(study).alias("study"), p.alias("params"), dropped_arr.alias("dropped_features"),
                         "metrics")
