"""A training-data pipeline over `documents`: every stage is one of the operators in calyx.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.llm import jaccard_join, line_dedup, mixing, perplexity, pieces
from calyx.llm.common import WORD, table, written
from calyx.llm.queries import PIECES

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is beyond their language's limit go."""
    return perplexity.good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document of which no word is left goes too."""
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("line_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them."""
    return pieces.encode_decode(docs, PIECES)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mixture", mixture), ("pieces", encode)]

#: SQL expresses neither the language model's float sums nor the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
