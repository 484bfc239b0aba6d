"""What the studies fit on, choose on and save."""

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from calyx.operators import models as M
from calyx.operators import profile as P
from calyx.operators import search as G
from calyx.operators import smote as SM
from calyx.plans import studies as ST
from calyx.sources import fixtures as FX
from conftest import SF_SMALL


def test_weights_come_from_the_train_part(spark):
    rows = spark.createDataFrame([(i, int(i < 3), "train" if i % 2 else "test") for i in range(11)], "id int, label int, split string")
    got = {r.label: r.weight for r in P.attach_weights(rows, counted=F.col("split") == "train").collect()}
    want = {r.label: r.weight for r in P.class_weights(rows.where("split = 'train'")).collect()}
    assert got == want
    prep = ST.prepare_loan(spark, SF_SMALL, weights=True)
    assert prep.train.agg(F.sum("weight")).first()[0] == pytest.approx(prep.n_train)


def test_only_synthetic_rows_are_truncated(spark):
    rows = spark.createDataFrame([(i, i + 0.7, i * 2.0, int(i < 4)) for i in range(12)], "id long, a double, b double, label int")
    out = SM.smote_resample(rows, ["a", "b"], k=2, keep_integers=["a"]).collect()
    assert sorted(r.a for r in out if not r.synthetic) == sorted(i + 0.7 for i in range(12))
    assert all(r.a == int(r.a) for r in out if r.synthetic) and any(r.synthetic for r in out)


def test_resampled_classifier_is_saved_whole(spark, tmp_path):
    rc = M.ResampledClassifier(M.random_forest(5, 3), smoteK=3, smoteSeed=7)
    rc.write().overwrite().save(str(tmp_path / "rc"))
    again = M.ResampledClassifier.load(str(tmp_path / "rc"))
    assert (again.getOrDefault("smoteK"), again.getOrDefault("smoteSeed"), again.uid) == (3, 7, rc.uid)
    assert again.classifier.getNumTrees() == 5 and again.classifier.getMaxDepth() == 3
    other = rc.copy({rc.smoteK: 2, rc.classifier.maxDepth: 4})
    assert other.getOrDefault("smoteK") == 2 and other.classifier.getMaxDepth() == 4 and rc.getOrDefault("smoteK") == 3
    train = VectorAssembler(inputCols=["income", "ccavg"], outputCol="features").transform(FX.loan_base(spark, SF_SMALL))
    assert again.fit(train).getNumTrees == 5


def test_run_summary_fits_what_the_rules_keep(spark, monkeypatch):
    seen = []
    whole = ST.lr_pipeline
    monkeypatch.setattr(ST, "lr_pipeline", lambda *a, **k: seen.append(k) or whole(*a, **k))
    dropped = ST.lr_run_summary(spark, SF_SMALL).first().dropped_features
    (given,) = seen
    assert dropped and not set(dropped) & set(given["numeric"]) and ST.VIF_PROTECTED <= set(given["numeric"])


def test_calibration_is_chosen_on_validation(spark, monkeypatch):
    parts = []

    def fake(spark, sf, method, part="test"):
        parts.append(part)
        return spark.createDataFrame([(1, 0.5)], "label int, score double")
    monkeypatch.setattr(ST, "calibrated_scores", fake)
    assert [r.method for r in ST.calibration_choice(spark, SF_SMALL).where("chosen").collect()] == ["sigmoid"]
    assert parts == ["validation"] * 2


def test_calibrated_scores_are_probabilities_of_the_part(spark):
    prep = ST.prepare_loan(spark, SF_SMALL, three_way=True)
    out = ST.calibrated_scores(spark, SF_SMALL, "sigmoid", k=2, part="validation").toPandas()
    assert sorted(out.id) == sorted(r.id for r in prep.validation.select("id").collect())
    assert out.score.between(0, 1).all() and out.score.nunique() > 5


def test_svm_curve_fits_an_svm_and_scores_its_margin(spark, monkeypatch):
    built = []
    monkeypatch.setattr(G, "validation_curve", lambda spark, build, *a: built.append(build(1.0)))
    ST.validation_curve_svm(spark, SF_SMALL)
    assert isinstance(built[0].getStages()[-1], LinearSVC)
    train = VectorAssembler(inputCols=["income"], outputCol="features").transform(FX.loan_base(spark, SF_SMALL))
    model = M.linear_svc(1.0, 1.0).fit(train)
    want = model.transform(train).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert G._score_split(model, train, "accuracy") == pytest.approx(want)


def test_margins_have_no_brier(spark):
    rows = spark.createDataFrame([(1, 2.0), (0, -1.0), (0, 0.5)], "label int, margin double")
    m = ST._margin_metrics(rows, "svm").first()
    assert m.brier is None and (m.tp, m.fp, m.tn, m.fn) == (1, 1, 1, 0)


def test_refit_takes_its_own_parameters(spark):
    from pyspark.ml import Pipeline
    rows = FX.loan_base(spark, SF_SMALL).withColumn("fold", (F.col("id") % 2).cast("int"))
    lr = M.logistic()
    pre = Pipeline(stages=[VectorAssembler(inputCols=["income"], outputCol="features")])
    _, model = G.grid_search_encoded(spark, pre, lr, [{lr.regParam: 0.5}], rows, n_folds=2, refit_maps=[{lr.regParam: 0.25}])
    assert model.stages[-1].getRegParam() == 0.25
