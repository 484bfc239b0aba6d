"""Invariants of splits, folds, SMOTE, models and persistence."""

import pytest
from pyspark.sql import functions as F

from calyx.operators import sampling as S
from calyx.operators import smote as SM
from calyx.plans import studies as ST
from calyx.sources import fixtures as FX
from conftest import SF_MID, SF_SMALL


def test_split_disjoint_complete_stratified(spark):
    base = FX.loan_base(spark, SF_MID)
    sp = S.stratified_split(base).toPandas()
    assert len(sp) == base.count() and sp.id.is_unique
    for lab, part in sp.groupby("label"):
        share = (part.split == "test").mean()
        assert abs((part.split == "test").sum() - 0.2 * len(part)) <= 1, share


def test_split_independent_of_partitioning(spark):
    base = FX.loan_base(spark, SF_SMALL)
    a = S.stratified_split(base).select("id", "split").toPandas().sort_values("id")
    b = S.stratified_split(base.repartition(7, "segment")).select("id", "split").toPandas().sort_values("id")
    assert list(a.split) == list(b.split)


def test_fold_sizes(spark):
    base = FX.loan_base(spark, SF_MID)
    f = S.kfold(base, k=5, shuffle=True).groupBy("fold", "label").count().toPandas()
    for lab, part in f.groupby("label"):
        assert part["count"].max() - part["count"].min() <= 1


def test_smote_balances_and_interpolates(spark):
    base = FX.loan_base(spark, SF_MID)
    feats = ["income", "ccavg", "mortgage"]
    syn = SM.smote(base, feats, k=5).toPandas()
    sizes = S.class_sizes(base)
    assert len(syn) == sizes[0] - sizes[1]
    pts = base.select("id", *feats).toPandas().set_index("id")
    reps = base.where("label = 1").groupBy(*feats).agg(F.min("id").alias("rep")).toPandas().set_index("rep")
    for r in syn.head(200).itertuples():
        x, n = pts.loc[r.base_id], reps.loc[r.nn_id]
        for c in feats:
            lo, hi = sorted((x[c], n[c]))
            assert lo - 1e-9 <= getattr(r, c) <= hi + 1e-9


def test_lr_learns_planted_signal(spark):
    m = ST.flagship(spark, SF_MID).first()
    assert m.roc_auc > 0.7


def test_model_roundtrip_equal(spark):
    out = ST.model_roundtrip(spark, SF_SMALL).toPandas()
    assert len(out) > 0 and out.equal.all()


def test_tree_importances_sum_to_one(spark):
    _, model = ST.tree_study(spark, SF_MID)
    assert sum(model.stages[-1].featureImportances.toArray()) == pytest.approx(1.0)


def test_batch_score_columns(spark):
    out = ST.batch_score(spark, SF_SMALL)
    assert out.columns[-2:] == ["Predicted Class", "Probability Personal Loan = 1"]
    assert out.count() == FX.loan_base(spark, SF_SMALL).count()


def test_missing_column_is_reported(spark):
    from calyx.sources.tables import require_columns
    with pytest.raises(ValueError, match="income"):
        require_columns(FX.loan_base(spark, SF_SMALL).drop("income"), ["id", "income"])


def test_run_summary_nested(spark):
    r = ST.lr_run_summary(spark, SF_SMALL).first()
    assert r.study == "logistic_regression" and r.params.C == 1.0
    assert set(r.metrics.asDict()) == {"train", "test"}
    assert "experience" in r.dropped_features or "age" in r.dropped_features


def test_smote_embeddings_balanced(spark):
    c = {(r.label, r.synthetic): r.n for r in ST.smote_embeddings(spark, SF_SMALL).collect()}
    assert c[(1, False)] + c.get((1, True), 0) == c[(0, False)]


def test_metrics_table_equals_separate_passes(spark):
    from calyx.operators import evaluate as E
    sv = FX.score_variants(spark, SF_SMALL)
    one = {r.variant: r for r in E.metrics_table(sv, 0.5, ["variant"]).collect()}
    conf = {r.variant: r for r in E.with_basic_metrics(E.confusion(sv, 0.5, ["variant"])).collect()}
    br = {r.variant: r.brier for r in E.brier(sv, ["variant"]).collect()}
    for v, r in one.items():
        assert (r.tn, r.fp, r.fn, r.tp) == (conf[v].tn, conf[v].fp, conf[v].fn, conf[v].tp)
        assert r.brier == pytest.approx(br[v], abs=1e-12)


def test_grid_best_is_first_maximum(spark):
    t = ST.grid_search_dt(spark, SF_SMALL).toPandas().sort_values("candidate")
    best = t[t.is_best]
    assert len(best) == 1
    top = t.mean_score.max()
    assert best.candidate.iloc[0] == t[t.mean_score == top].candidate.min()


def test_threshold_sweep_grid(spark):
    from calyx.operators import evaluate as E
    sw = E.threshold_sweep(FX.scores(spark, SF_SMALL)).toPandas().sort_values("threshold")
    assert len(sw) == 91 and sw.threshold.min() == 0.05 and sw.threshold.max() == 0.95
    assert (sw.recall.diff().dropna() <= 1e-12).all()  # recall never rises with the threshold
