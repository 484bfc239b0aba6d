"""Shared pieces of the training-data operators: scratch tables, byte-bounded text slices, word runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.session import ensure_checkpoint_dir

#: A word is a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a task; a single longer text is handled alone.
SLICE_BYTES = 8 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, visible to all executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/calyx-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """`docs` with the columns other than `used` under names of their own, which clash with none that an operator adds."""
    return docs.toDF(*[c if c in used else f"aside_{i}" for i, c in enumerate(docs.columns)])


def word_count(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_parts(spark: SparkSession, factor: int = 1) -> int:
    """Partition count for an explicit repartition: the session's shuffle setting, which operations size to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that `column` holds about `limit` bytes in each piece (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(lengths) // limit
    edges = np.flatnonzero(np.diff(piece)) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def to_record_batches(arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
