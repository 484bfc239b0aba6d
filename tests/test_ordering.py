"""Ordered operators over many range partitions, against DuckDB and numpy."""

import duckdb
import numpy as np
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from calyx.operators import evaluate as E
from calyx.operators import ranking as R
from calyx.operators.smote import smote


@pytest.fixture()
def many_buckets(monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 1)
    monkeypatch.setattr(R, "choose_buckets", lambda n, rows_per_bucket=None: 60)


def line(spark):
    return spark.read.parquet(f"{SF_MID}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))


def test_quantiles_over_many_buckets(spark, many_buckets):
    got = R.exact_quantiles(line(spark), "price", [0.25, 0.5, 0.75], ["l_returnflag"]).toPandas().set_index("l_returnflag")
    want = duckdb.sql(f"""SELECT l_returnflag, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.25, 0.5, 0.75]) AS q
                          FROM '{SF_MID}/lineitem.parquet' GROUP BY 1""").fetchall()
    for flag, q in want:
        assert got.loc[flag, ["q25", "q50", "q75"]].tolist() == pytest.approx(q)
    one = R.exact_quantiles(line(spark), "price", [0.5]).first()
    assert one["q50"] == pytest.approx(duckdb.sql(f"SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) FROM '{SF_MID}/lineitem.parquet'").fetchall()[0][0])


def test_ranks_over_many_buckets_without_a_cross_join(spark, many_buckets):
    ranked = R.rank_by_value(line(spark), [], "price", ["l_orderkey", "l_linenumber"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = ranked.orderBy("rank").select("rank", "price").toPandas()
    assert got["rank"].tolist() == list(range(1, len(got) + 1)) and got["price"].is_monotonic_increasing


def test_curve_ends_and_areas(spark, many_buckets):
    rng = np.random.default_rng(3)
    rows = [(float(s), int(rng.random() < s)) for s in np.round(rng.random(500), 2)]
    df = spark.createDataFrame(rows, "score double, label int")
    roc = E.roc_curve(df).orderBy(F.col("threshold").desc_nulls_first()).toPandas()
    assert roc.iloc[0][["fpr", "tpr"]].tolist() == [0, 0] and roc.iloc[-1][["fpr", "tpr"]].tolist() == [1, 1]
    assert E.areas(df).first()["roc_auc"] == pytest.approx(float(np.trapezoid(roc["tpr"], roc["fpr"])))
    pr = E.pr_curve(df).orderBy(F.col("threshold").desc_nulls_first()).toPandas()
    assert pr.iloc[0][["precision", "recall"]].tolist() == [1, 0]


def test_thresholds_and_bins_do_not_round(spark):
    rows = [(0.4999999, 1), (0.5, 1), (0.29, 0), (0.1000001, 1), (0.1, 0), (1.0, 1), (0.0, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    sweep = {round(r["threshold"], 2): r["recall"] for r in E.threshold_sweep(df).collect()}
    for t in (0.05, 0.1, 0.29, 0.5, 0.95):
        assert sweep[t] == pytest.approx(sum(s >= t and y for s, y in rows) / 4)
    assert {r["bin"]: r["n"] for r in E.calibration_curve(df).collect()} == {0: 2, 1: 1, 2: 1, 4: 2, 9: 1}


def test_smote_refuses_nulls(spark):
    df = spark.createDataFrame([(i, 1 if i < 8 else 0, None if i == 3 else float(i)) for i in range(30)], "id long, label int, x double")
    with pytest.raises(ValueError, match="impute"):
        smote(df, ["x"])
