"""The whole logistic-regression chain: six ranked variants of one study."""

import pytest

from calyx.functions.exprs import engineer_features
from calyx.operators import evaluate as E
from calyx.operators import models as M
from calyx.operators import sampling as S
from calyx.plans import lr_study as LR
from calyx.plans import studies as ST
from conftest import SF_SMALL


def test_six_ranked_variants(spark):
    rows = LR.lr_study(spark, SF_SMALL, Cs=(0.1, 1.0), penalties=("l2",)).orderBy("rank").collect()
    by_name = {r["variant"]: r for r in rows}
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert {"Baseline LR", "Tuned LR (0.50)", "Tuned LR (Best F1 Thr)", "Balanced LR", "SMOTE LR"} < set(by_name)
    assert [(-r["f1"], -r["roc_auc"], -r["recall"]) for r in rows] == sorted((-r["f1"], -r["roc_auc"], -r["recall"]) for r in rows)
    half, best = by_name["Tuned LR (0.50)"], by_name["Tuned LR (Best F1 Thr)"]
    assert half["roc_auc"] == best["roc_auc"] and half["brier"] == best["brier"]
    assert 0.05 <= best["threshold"] <= 0.95 and half["threshold"] == 0.5
    assert half["C"] in (0.1, 1.0) and half["penalty"] == "l2"
    n_test = ST.prepare_loan(spark, SF_SMALL, three_way=True).test.count()
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == n_test for r in rows)


def test_kept_columns_obey_both_rules(spark):
    from calyx.operators import collinearity as CO
    train = engineer_features(ST.prepare_loan(spark, SF_SMALL, three_way=True, weights=True).train)
    kept = LR.kept_columns(train)
    assert not {"id", "label", "weight"} & set(kept) and ST.VIF_PROTECTED <= set(kept)
    over = [r["feature"] for r in CO.vif_table(train, kept).collect() if r["vif"] > 10.0]
    assert set(over) <= ST.VIF_PROTECTED


def test_calibrated_is_the_mean_over_folds(spark):
    prep = ST.prepare_loan(spark, SF_SMALL, three_way=True)
    folded = S.kfold(prep.train, k=2, shuffle=False).cache()
    rows = prep.test.selectExpr("*", "'test' as part")
    pipe = ST.lr_pipeline(1.0, "l2", prep.n_train / 2)
    got = {r["id"]: r for r in LR.calibrated(folded, rows, pipe.fit, k=2).collect()}
    want: dict = {}
    for f in range(2):
        model = pipe.fit(folded.where(f"fold != {f}"))
        margins = M.margin(model.transform(folded.where(f"fold = {f}"))).select("label", "margin")
        cal = M.PlattCalibrator(inputCol="margin", outputCol="s").fit(margins)
        for r in cal.transform(M.margin(model.transform(prep.test))).select("id", "s").collect():
            want[r["id"]] = want.get(r["id"], 0.0) + r["s"] / 2
    assert got.keys() == want.keys()
    assert all(got[i]["sigmoid"] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert all(0.0 <= r["isotonic"] <= 1.0 for r in got.values())
    assert E.brier(spark.createDataFrame([(1, 1.0)], "label int, score double")).first()["brier"] == 0.0
