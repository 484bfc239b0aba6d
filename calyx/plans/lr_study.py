"""The logistic-regression study as one chain, from raw rows to six ranked variants.

Kept columns (pair and VIF rules on the train rows) -> baseline -> whole grid by
ROC AUC -> threshold of best F1 on the validation rows -> tuned model at 0.5 and
at that threshold -> balanced and SMOTE refits with the best parameters ->
calibration of the tuned parameters out of fold, sigmoid or isotonic by the
validation Brier score (a tie goes to sigmoid) -> test metrics, ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions.exprs import engineer_features, numeric_columns
from calyx.operators import collinearity as CO
from calyx.operators import encode as EN
from calyx.operators import evaluate as E
from calyx.operators import models as M
from calyx.operators import sampling as S
from calyx.operators import search as G
from calyx.operators import smote as SM
from calyx.plans import studies as ST
from calyx.session import cut_lineage

FOLDS = 5


def kept_columns(train: DataFrame) -> list[str]:
    """Numeric columns of the engineered train rows that the pair rule and the VIF rule leave."""
    pair = CO.drop_high_corr_pair(train, "age", "experience").first()
    numeric = [c for c in numeric_columns(train, ("id", "label", "weight")) if c != pair["dropped"]]
    return CO.vif_filter(train, numeric, 10.0, protected=ST.VIF_PROTECTED)[0]


def calibrated(folded: DataFrame, rows: DataFrame, fit, k: int = FOLDS) -> DataFrame:
    """`rows` (id, label, part, ...) as (id, label, part, sigmoid, isotonic): for each fold a model fitted on the others and
    both calibrators on its margins there; a row's score is the mean over folds."""
    def one(f: int) -> DataFrame:
        others, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        model = fit(others)
        margins = M.margin(model.transform(held)).select("label", "margin")
        sigmoid = M.PlattCalibrator(inputCol="margin", outputCol="sigmoid").fit(margins)
        isotonic = M.isotonic_model(margins, "margin", "label").setFeaturesCol("margin").setPredictionCol("isotonic")
        scored = isotonic.transform(sigmoid.transform(M.margin(model.transform(rows)).select("id", "label", "part", "margin")))
        return scored.select("id", "label", "part", "sigmoid", "isotonic")

    each = reduce(DataFrame.unionByName, G.in_threads(folded.sparkSession, one, range(k)))
    return each.groupBy("id", "label", "part").agg(F.avg("sigmoid").alias("sigmoid"), F.avg("isotonic").alias("isotonic"))


def lr_study(spark: SparkSession, sf: str, Cs: Sequence[float] = ST.LR_GRID_C, penalties: Sequence[str] = ("l1", "l2")) -> DataFrame:
    """Six rows: variant, threshold, C, penalty, n_columns, test metrics, rank (by F1, then ROC AUC, then recall)."""
    prep = ST.prepare_loan(spark, sf, three_way=True, weights=True)
    n = prep.n_train
    # each iteration of a fit is a job, which takes the plan behind its rows along
    train, validation, test = (cut_lineage(S.for_fits(engineer_features(d), n, fit_rows=S.NARROW_FIT_ROWS)) for d in (prep.train, prep.validation, prep.test))
    kept = kept_columns(train)
    categorical = [*ST.CATEGORICAL, "age_bin", "income_bin"]
    total_weight = train.agg(F.sum("weight")).first()[0]

    def chain(C: float, penalty: str, weight: float, weight_col: str | None = None) -> Pipeline:
        return ST.lr_pipeline(C, penalty, weight, weight_col, kept, categorical)

    metrics: list[DataFrame] = []

    def add(name: str, scores: DataFrame, threshold: float, C: float, penalty: str) -> None:
        found = E.metrics_table(scores.select("label", "score", F.lit(name).alias("variant")), threshold, ["variant"])
        metrics.append(found.select("*", F.lit(float(C)).alias("C"), F.lit(penalty).alias("penalty"), F.lit(len(kept)).alias("n_columns")))

    add("Baseline LR", ST.score(chain(1.0, "l2", n).fit(train), test), 0.5, 1.0, "l2")

    folded = cut_lineage(S.kfold(train, k=FOLDS, shuffle=False))
    estimator, grid = M.logistic(1.0, "l2", 1.0, max_iter=100), [(p, C) for p in penalties for C in Cs]

    def maps(weight: float) -> list[dict]:
        return [{estimator.regParam: 1.0 / (C * weight), estimator.elasticNetParam: 1.0 if p == "l1" else 0.0} for p, C in grid]

    table, tuned = G.grid_search_encoded(spark, EN.preprocessor(None, kept, categorical), estimator, maps(n * (FOLDS - 1) / FOLDS),
                                         folded, "roc_auc", FOLDS, refit_maps=maps(n))
    penalty, C = grid[table.where("is_best").first()["candidate"]]
    sweep = E.threshold_sweep(ST.score(tuned, validation).select("label", "score", F.lit("tuned").alias("variant")), ["variant"])
    cut = E.best_thresholds(sweep, ["variant"]).first()["best_f1_threshold"]
    tuned_scores = ST.score(tuned, test).persist()
    add("Tuned LR (0.50)", tuned_scores, 0.5, C, penalty)
    add("Tuned LR (Best F1 Thr)", tuned_scores, cut, C, penalty)

    add("Balanced LR", ST.score(chain(C, penalty, total_weight, "weight").fit(train), test), 0.5, C, penalty)

    encoder = EN.preprocessor(None, kept, categorical).fit(train)
    resampled = cut_lineage(SM.smote_vectors(encoder.transform(train), "features", "label", k=5, seed=ST.SEED).repartition(max(1, 2 * n // S.NARROW_FIT_ROWS)))
    fitted = M.logistic(C, penalty, resampled.count()).fit(resampled)
    add("SMOTE LR", M.positive_probability(fitted.transform(encoder.transform(test))), 0.5, C, penalty)

    both = validation.withColumn("part", F.lit("validation")).unionByName(test.withColumn("part", F.lit("test")))
    scores = calibrated(folded, both, chain(C, penalty, n * (FOLDS - 1) / FOLDS).fit).persist()
    brier = {m: E.brier(scores.where("part = 'validation'").select("label", F.col(m).alias("score"))).first()["brier"]
             for m in ("sigmoid", "isotonic")}
    name, method = ("Calibrated LR (Platt)", "sigmoid") if brier["sigmoid"] <= brier["isotonic"] else ("Calibrated LR (Isotonic)", "isotonic")
    add(name, scores.where("part = 'test'").select("label", F.col(method).alias("score")), 0.5, C, penalty)

    ranked = E.rank_models(reduce(DataFrame.unionByName, metrics))
    rows = ranked.collect()  # one row a variant
    for held in (scores, tuned_scores):
        held.unpersist()
    return spark.createDataFrame(rows, ranked.schema)
