"""Every query with a SQL twin returns the same rows as DuckDB (sf0.001)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
KEYS = sorted(entry.oracle_sql())


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return int(r) if r.is_integer() else r
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_sql_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[key]).df()
    assert _rows(got) == _rows(want)
