"""Splits and folds by cut value, quantiles by selection: against ranks, and without a shuffle of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calyx.functions.hashing import uniform_int
from calyx.operators import ranking as R
from calyx.operators import sampling as S
from calyx.sources import fixtures as FX
from conftest import SF_MID


@pytest.fixture(params=[(4096, 20_000), (4, 3), (1000, 1)])
def slices(request, monkeypatch):
    monkeypatch.setattr(S, "SLICES", request.param[0])
    monkeypatch.setattr(S, "FEW", request.param[1])


def base(spark):
    return FX.loan_base(spark, SF_MID).select("id", "label", "segment")


def by_hash(spark, seed=42):
    rows = base(spark).select("id", "label", uniform_int(F.col("id"), seed=seed).alias("u")).collect()
    return {c: [r.id for r in sorted((r for r in rows if r.label == c), key=lambda r: (r.u, r.id))] for c in {r.label for r in rows}}


def test_splits_are_those_of_the_ranks(spark, slices):
    order = by_hash(spark)
    sizes = {c: len(ids) for c, ids in order.items()}
    temp, _ = S.split_sizes(sizes, 0.2)
    train, _ = S.split_sizes(temp, 0.25)
    got = {r.id: r.split for r in S.three_way_split(base(spark)).collect()}
    for c, ids in order.items():
        assert [got[i] for i in ids] == ["train"] * train[c] + ["validation"] * (temp[c] - train[c]) + ["test"] * (sizes[c] - temp[c])


@pytest.mark.parametrize("shuffle", [False, True])
def test_folds_are_those_of_the_ranks(spark, slices, shuffle):
    order = by_hash(spark) if shuffle else {c: sorted(ids) for c, ids in by_hash(spark).items()}
    alloc = S.fold_allocation({c: len(ids) for c, ids in order.items()}, 5)
    got = {r.id: r.fold for r in S.kfold(base(spark), shuffle=shuffle).collect()}
    for c, ids in order.items():
        assert [got[i] for i in ids] == [f for f, n in enumerate(alloc[c]) for _ in range(n)]


def test_few_rows_and_text_ids(spark):
    rows = spark.createDataFrame([(f"r{i:02d}", int(i == 3)) for i in range(11)], "id string, label int")
    got = {r.id: r.fold for r in S.kfold(rows, k=3).collect()}
    assert sorted(got) == [f"r{i:02d}" for i in range(11)] and set(got.values()) == {0, 1, 2}
    split = S.stratified_split(rows, test_size=0.3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 7, "test": 4}
    assert S.stratified_split(rows.where("label = 1"), test_size=0.5).first().split == "test"


@pytest.mark.parametrize("make", [S.stratified_split, S.three_way_split, S.kfold, lambda d: S.kfold(d, shuffle=True), S.train_ratio_sweep])
def test_no_row_is_shuffled(spark, make):
    plain = spark.read.parquet(f"{SF_MID}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 1e5).cast("int").alias("label"))
    plan = make(plain)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


@pytest.fixture(params=[(10_000, 20_000, 1_000_000), (100, 200, 1_000_000), (50, 10, 0)])
def sketches(request, monkeypatch):
    for name, value in zip(("ACCURACY", "SMALL_GROUP", "BRACKETED"), request.param, strict=True):
        monkeypatch.setattr(R, name, value)


def test_quantiles_are_exact(spark, sketches):
    rng = np.random.default_rng(1)
    values = {"plain": rng.normal(size=3000), "ties": rng.integers(0, 5, 2500).astype(float), "hot": np.r_[np.full(1500, 7.0), rng.normal(size=1000)], "one": np.array([4.0]),
              "two": np.array([1.0, 2.0])}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("plain", None), ("none", None)], "g string, v double")
    got = {r.g: r for r in R.exact_quantiles(frame, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g].n == len(vs)
        assert [got[g][f"q{p}"] for p in (0, 25, 50, 90, 100)] == pytest.approx(np.quantile(vs, [0, 0.25, 0.5, 0.9, 1]).tolist())
    whole = R.exact_quantiles(frame, "v", [0.5]).first()
    assert whole.q50 == pytest.approx(np.median(np.concatenate(list(values.values()))))
