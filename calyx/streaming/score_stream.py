"""Stream scoring (I3): the batch scorer applied to a file stream, with rejects.

Each micro-batch goes to two sinks: rows that have all columns of the model are
scored, the others are kept with the names of what they lack.  A batch writes
the folder of its own number and replaces it if it runs again, so a query that
is stopped between the two sinks, or before its commit, leaves every row once
when it is restarted on the same checkpoint folder.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from calyx.functions.exprs import apply_threshold, clip_lower, missing_names
from calyx.operators.models import positive_probability

SCORED = ["Predicted Class", "Probability Personal Loan = 1"]


def score_stream(spark: SparkSession, model_path: str, source_dir: str, schema: StructType, columns: list[str],
                 checkpoint_dir: str, output_dir: str, rejects_dir: str, threshold: float = 0.5,
                 available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Start a streaming query over the parquet files of `source_dir`, present and future ones (`available_now`: present
    ones only).  Scored rows go to `output_dir`, rows with a null in `columns` to `rejects_dir`; all folders are shared."""
    absent = [c for c in ["id", *columns] if c not in schema.names]
    if absent:
        raise ValueError(f"the stream lacks the columns {absent}")
    model = PipelineModel.load(model_path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source_dir).select("id", *columns, missing_names(columns).alias("missing_columns"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        whole = batch.where("missing_columns = ''").drop("missing_columns")
        scored = positive_probability(model.transform(whole.withColumn("experience", clip_lower("experience"))), out="_p")
        scored = scored.select("id", *columns, apply_threshold("_p", threshold).alias(SCORED[0]), F.col("_p").alias(SCORED[1]))
        scored.write.mode("overwrite").parquet(f"{output_dir}/batch={number}")
        batch.where("missing_columns != ''").write.mode("overwrite").parquet(f"{rejects_dir}/batch={number}")
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def run_to_completion(spark: SparkSession, query: StreamingQuery, output_dir: str, rejects_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rejected rows) when an `available_now` query has ended."""
    query.awaitTermination()
    return tuple(spark.read.parquet(folder).drop("batch") for folder in (output_dir, rejects_dir))
