"""Table readers and schema checks (A1, A2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed schemas of the test tables (column: type), so no inference pass runs.
SCHEMAS: dict[str, T.StructType] = {
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType())]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampType())]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType())]),
}


#: The column of lines that do not fit the schema, and how CSV files write timestamps.
BAD_LINE = "bad_line"
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def good_lines(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A CSV table's rows that fit the schema, and (bad_line) the lines that don't."""
    return df.where(f"{BAD_LINE} is null").drop(BAD_LINE), df.where(f"{BAD_LINE} is not null").select(BAD_LINE)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str, fmt: str = "parquet",
               header: bool = True, path: str | None = None) -> DataFrame:
    """Read one table with its declared schema, from parquet (by default) or CSV, at `path` or in `sf_dir`.

    CSV is read as it comes: a field that does not fit its type is null, and the line is kept whole in BAD_LINE, which
    is null for good lines.
    """
    reader = spark.read
    schema = SCHEMAS.get(name)
    if fmt == "csv":
        if schema is None:
            raise ValueError(f"CSV read of {name!r} needs a declared schema")
        lines = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
        return (reader.schema(lines).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
                .option("timestampFormat", CSV_TIME).csv(path or table_path(sf_dir, name).replace(".parquet", ".csv")))
    df = reader.parquet(path or table_path(sf_dir, name))
    if schema is not None:
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
    return df


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail with the list of missing columns, else project in the saved order (A2)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Drop columns; strict mode raises on absent names, lenient ignores them (B2)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError("Cannot drop absent columns: " + ", ".join(missing))
    return df.drop(*cols)
