"""Edge cases: NULLs, ties, constant columns, unseen categories, empty bins."""

import math

import pytest
from pyspark.sql import functions as F

from calyx.functions.exprs import apply_threshold, clip_lower, right_closed_bins
from calyx.operators import collinearity as C
from calyx.operators import encode as EN
from calyx.operators import evaluate as E


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (5.0,)], "x double")
    assert [r[0] for r in df.select(clip_lower("x")).collect()] == [0.0, None, 5.0]


def test_threshold_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "s double")
    assert [r[0] for r in df.select(apply_threshold("s", 0.5)).collect()] == [1, 0]


def test_bins_right_closed_and_nan(spark):
    df = spark.createDataFrame([(20.0,), (30.0,), (30.5,), (90.0,), (None,)], "a double")
    got = [r[0] for r in df.select(right_closed_bins("a", [20, 30, 40], ["20s", "30s"])).collect()]
    assert got == ["nan", "20s", "30s", "nan", "nan"]


def test_all_tied_scores_auc_half(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(10)], "label int, score double")
    assert E.areas(df).first().roc_auc == pytest.approx(0.5)


def test_single_class_auc_nan_and_zero_metrics(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.7)], "label int, score double")
    r = E.metrics_table(df).first()
    assert math.isnan(r.roc_auc) and r.recall == 0.0 and r.precision == 0.0


def test_calibration_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2), (1, 1.0), (0, 0.0)], "label int, score double")
    bins = {r.bin: r.n for r in E.calibration_curve(df).collect()}
    assert bins == {0: 2, 1: 1, 9: 1}


def test_constant_column_vif_inf(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 3)) for i in range(30)], "a double, b double, c double")
    v = {r.feature: r.vif for r in C.vif_table(df, ["a", "b", "c"]).collect()}
    assert math.isinf(v["b"]) and v["a"] < 10


def test_zero_std_scaler(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    out = EN.PopulationScaler(inputCols=["x"]).fit(df).transform(df)
    assert [r.x for r in out.collect()] == [0.0, 0.0]


def test_unseen_category_all_zeros(spark):
    tr = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    te = spark.createDataFrame([("b",), ("z",), (None,)], "s string")
    m = EN.DropFirstOneHot(inputCols=["s"]).fit(tr)
    rows = m.transform(te).select(*m.outputCols()).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_median_is_midpoint(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    m = EN.MedianImputer(inputCols=["x"]).fit(df)
    assert m.getStats() == [6.0]
    assert m.transform(df).where(F.col("x") == 6.0).count() == 1


def test_kde_skips_zero_bandwidth_class(spark):
    from calyx.operators.profile import kde_by_class
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 0.5), (1, 2.0), (1, 3.0)], "label int, v double")
    out = kde_by_class(df, "v", grid=20).toPandas()
    assert set(out.label) == {1} and len(out) == 20
    step = out.sort_values("grid_index").x.diff().dropna().mean()
    assert (out.density.sum() * step) == pytest.approx(1.0, abs=0.05)
