"""Study tables derived from the test tables (FIXTURES.md §2).

`loan_base` re-creates the shape of the loan table from customers and their
orders; `scores` is a calibrated scores table for every evaluator; `line_base`
is the large-scale variant over lineitem; `doc_base` carries real labels.
All are lazy DataFrames: Catalyst prunes the columns a caller does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions.hashing import uniform
from calyx.sources.tables import load_table

# Feature columns of the loan-shaped table, in saved order.
LOAN_FEATURES = ["age", "experience", "income", "zip", "family", "ccavg", "education",
                 "mortgage", "securities_account", "cd_account", "online", "creditcard"]
LOAN_NUMERIC = ["age", "experience", "income", "family", "ccavg", "education", "mortgage",
                "securities_account", "cd_account", "online", "creditcard"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def loan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders")
    customer = load_table(spark, sf_dir, "customer")
    # Partial aggregation runs map-side, so a customer holding a large share of
    # orders is combined before the shuffle on o_custkey.
    o = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("spend"),
        F.avg("o_totalprice").alias("avg_order"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("n_urgent"),
    )
    b = customer.join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("id"),
        F.round(F.lit(25) + F.col("c_acctbal") / 100.0 + F.col("n_urgent"), 4).alias("age"),
        F.round(F.col("c_acctbal") / 100.0, 4).alias("experience"),
        F.round(F.col("spend") / 40000.0, 4).alias("income"),
        F.col("c_nationkey").alias("zip"),
        (F.lit(1) + F.col("n_orders") % 4).cast("int").alias("family"),
        F.round(F.col("avg_order") / 100000.0, 4).alias("ccavg"),
        (F.lit(1) + F.col("c_custkey") % 3).cast("int").alias("education"),
        F.round(F.greatest(F.col("spend") / 10000.0 - 250, F.lit(0.0)), 4).alias("mortgage"),
        F.when(F.col("n_urgent") >= 3, 1).otherwise(0).alias("securities_account"),
        F.when(F.col("n_urgent") >= 5, 1).otherwise(0).alias("cd_account"),
        F.when(F.col("c_custkey") % 5 < 3, 1).otherwise(0).alias("online"),
        F.when(F.col("c_custkey") % 10 < 3, 1).otherwise(0).alias("creditcard"),
        F.col("c_mktsegment").alias("segment"),
        uniform(F.concat(F.lit("loan|"), F.col("c_custkey").cast("string"))).alias("u"),
    )
    z = (F.col("income") / 20.0 + F.col("experience") / 40.0
         + F.when(F.col("segment") == "BUILDING", 1.0).otherwise(0.0) - 7.0)
    s = b.withColumn("p", F.round(_sigmoid(z), 6))
    return s.withColumn("label", F.when(F.col("u") < F.col("p"), 1).otherwise(0))


def loan_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loan_base with derived NULLs: income when id%7==0, segment when id%11==0,
    ccavg when id%13==0 (the test tables themselves have none)."""
    df = loan_base(spark, sf_dir)
    return (df.withColumn("income", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("income")))
              .withColumn("segment", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("segment")))
              .withColumn("ccavg", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("ccavg"))))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores table: planted probability as the score."""
    return loan_base(spark, sf_dir).select("id", "label", F.col("p").alias("score"))


# Names of the planted score variants; the set is part of the fixture.
VARIANTS = ("lr_planted", "LR_sqrt", "tree_tied")


def score_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of one score: calibrated, mis-calibrated with the same
    ranking, and heavily tied.  Long table (variant, id, label, score)."""
    base = loan_base(spark, sf_dir).select("id", "label", "p")
    exprs = {
        "lr_planted": F.col("p"),
        "LR_sqrt": F.round(F.sqrt("p"), 6),
        "tree_tied": F.round("p", 1),
    }
    # One scan, fanned out by a generator rather than three scans and a union.
    arr = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("score")) for k, v in exprs.items()])
    return (base.select("id", "label", F.explode(arr).alias("v"))
                .select(F.col("v.variant").alias("variant"), "id", "label", F.col("v.score").alias("score")))


def line_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("li|"), F.concat_ws("|", *[F.col(c).cast("string") for c in
                                                   ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]]))
    b = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  uniform(key).alias("u"),
                  F.round(_sigmoid(F.col("l_quantity") / 12.0 + 20.0 * F.col("l_discount") - 6.0), 6).alias("p"))
    return b.withColumn("label", F.when(F.col("u") < F.col("p"), 1).otherwise(0))


def doc_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels")
    n_words = (F.length("text") - F.length(F.regexp_replace("text", " ", "")) + 1).cast("bigint")
    return (docs.join(labels, "doc_id")
                .select("doc_id", "lang", "source", "n_chars", "quality", "toxic",
                        n_words.alias("n_words"),
                        F.round(F.col("n_chars") / n_words.cast("double"), 4).alias("chars_per_word")))


def vec_base(spark: SparkSession, sf_dir: str, positive_label: int = 0) -> DataFrame:
    """Embeddings with a one-vs-rest binary label (8-13 % positive)."""
    emb = load_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), "embedding",
                      F.when(F.col("label") == positive_label, 1).otherwise(0).alias("label"))
