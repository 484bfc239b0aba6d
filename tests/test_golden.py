"""Arithmetic checks against numbers the reference stored (retyped here)."""

import pytest
from pyspark.sql import functions as F

from calyx.operators import evaluate as E
from calyx.operators import sampling as S


# TN, FP, FN, TP -> accuracy, precision, recall, F1 (stored metric rows of the LR study)
GOLDEN = [
    ((892, 12, 17, 79), (0.971, 0.8681318681, 0.8229166667, 0.8449197861)),
    ((887, 17, 14, 82), (0.969, 0.8282828283, 0.8541666667, 0.8410256410)),
    ((828, 76, 4, 92), (0.920, 0.5476190476, 0.9583333333, 0.6969696970)),
]


@pytest.mark.parametrize("counts,expected", GOLDEN)
def test_metrics_from_counts(spark, counts, expected):
    df = spark.createDataFrame([counts], "tn bigint, fp bigint, fn bigint, tp bigint")
    r = E.with_basic_metrics(df).first()
    for got, want in zip((r.accuracy, r.precision, r.recall, r.f1), expected):
        assert got == pytest.approx(want, abs=1e-9)


def test_split_allocation_5000():
    # 4520 negatives / 480 positives, 20 % test -> 904 / 96 in the test part
    train, test = S.split_sizes({0: 4520, 1: 480}, 0.2)
    assert test == {0: 904, 1: 96}
    assert train == {0: 3616, 1: 384}


def test_three_way_sizes_5000():
    temp, test = S.split_sizes({0: 4520, 1: 480}, 0.2)
    train, val = S.split_sizes(temp, 0.25)
    assert sum(train.values()) == 3000 and sum(val.values()) == 1000 and sum(test.values()) == 1000


def test_metric_deltas(spark):
    # improved - baseline of the older study: accuracy -0.014, FN -17, FP +31
    rows = [("baseline", 0.952, 0.8157894737, 0.6458333333, 0.7209302326, 0.9644, 0.8284, 34, 14),
            ("improved", 0.938, 0.6370967742, 0.8229166667, 0.7181818182, 0.9641, 0.8117, 17, 45)]
    m = spark.createDataFrame(rows, "variant string, accuracy double, precision double, recall double, f1 double, "
                                    "roc_auc double, pr_auc double, fn bigint, fp bigint")
    d = {r.metric: r.delta for r in E.compare_variants(m, "baseline", "improved").collect()}
    assert d["accuracy"] == pytest.approx(-0.014, abs=1e-9)
    assert d["precision"] == pytest.approx(-0.1786926995, abs=1e-9)
    assert d["recall"] == pytest.approx(0.1770833333, abs=1e-9)
    assert d["fn"] == -17 and d["fp"] == 31


def test_best_threshold_rule(spark):
    # max F1 then recall; max Youden J - ties resolved to the lowest threshold
    rows = [(0.34, 0.80, 0.85, 0.87, 0.80), (0.35, 0.82, 0.88, 0.8791208791, 0.81),
            (0.36, 0.85, 0.86, 0.8791208791, 0.79), (0.23, 0.5, 0.95, 0.70, 0.8550884956)]
    sw = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double, youden_j double")
    r = E.best_thresholds(sw.withColumn("g", F.lit(1)), ["g"]).first()
    assert r.best_f1_threshold == 0.35 and r.best_j_threshold == 0.23
