"""Rows of iterative fits: few partitions for few rows, a short plan, bounded partitions for many rows."""

import pytest
from pyspark.sql import functions as F

from calyx.operators import models as M
from calyx.operators import sampling as S
from calyx.plans import studies as ST

CUSTOMERS = 400


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("fit-rows"))
    spark.range(CUSTOMERS).select(
        F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), (F.col("id") * 37 % 9000).cast("double").alias("c_acctbal"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), (F.col("id") % 2 + 1).cast("int")).alias("c_mktsegment")).write.parquet(f"{at}/customer.parquet")
    spark.range(CUSTOMERS * 10).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % CUSTOMERS).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate"),
        (F.col("id") * 7919 % 300000).cast("double").alias("o_totalprice"),
        F.when(F.col("id") % 3 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority")).write.parquet(f"{at}/orders.parquet")
    return at


def test_prepared_rows_come_in_partitions_by_their_number(spark, tables):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for three_way in (False, True):
            prep = ST.prepare_loan(spark, tables, three_way=three_way, weights=True)
            assert prep.train.rdd.getNumPartitions() == 1
            assert "Exchange" not in prep.train._jdf.queryExecution().executedPlan().toString()
            parts = [p for p in (prep.train, prep.test, prep.validation) if p is not None]
            assert sum(p.count() for p in parts) == CUSTOMERS
            assert len({r["id"] for p in parts for r in p.select("id").collect()}) == CUSTOMERS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_rows_in_one_partition_are_dealt_out(spark):
    rows = spark.range(1000).coalesce(1)
    dealt = S.for_fits(rows, 1000, fit_rows=64)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 16 and max(sizes) < 200
    assert sorted(r["id"] for r in dealt.collect()) == list(range(1000))


def test_both_calibrations_in_one_pass_are_those_of_each_alone(spark, tables, monkeypatch):
    fits, logistic = [], M.logistic
    monkeypatch.setattr(M, "logistic", lambda *a, **k: fits.append(1) or logistic(*a, **k))
    both = ST.calibrated_columns(spark, tables, ["sigmoid", "isotonic"], k=2, part="validation").persist()
    assert len(fits) == 2  # one model a fold, not one for each method
    monkeypatch.undo()
    for method in ("sigmoid", "isotonic"):
        alone = ST.calibrated_scores(spark, tables, method, k=2, part="validation")
        assert abs(ST.E.brier(alone).first()["brier"] - ST.E.brier(both.withColumnRenamed(method, "score")).first()["brier"]) < 1e-9


def test_tree_grid_fits_keep_nodes_and_take_large_partitions(spark, tables, monkeypatch):
    dealt, for_fits, fits, tree = [], S.for_fits, [], M.decision_tree
    monkeypatch.setattr(S, "for_fits", lambda *a, **k: dealt.append(k.get("fit_rows")) or for_fits(*a, **k))
    monkeypatch.setattr(M, "decision_tree", lambda *a, **k: fits.append(tree(*a, **k)) or fits[-1])
    grid = {"criterion": ("gini",), "max_depth": (2, None), "min_samples_leaf": (1, 5), "class_weight": (None, "balanced")}
    found = {r["params"]: r["mean_score"] for r in ST.grid_search_dt(spark, tables, grid).collect()}
    assert len(found) == 8 and dealt == [S.NARROW_FIT_ROWS]
    assert len(fits) == 5 * 4 and all(f.getCacheNodeIds() for f in fits)
    monkeypatch.setattr(M.DecisionTreeClassifier, "setCacheNodeIds", lambda self, _: self)  # as without it
    assert {r["params"]: r["mean_score"] for r in ST.grid_search_dt(spark, tables, grid).collect()} == found
