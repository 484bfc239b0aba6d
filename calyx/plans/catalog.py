"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each runs the operator over whole study tables derived from the test tables.
Doubles are rounded to 6 decimals at the end so that the DuckDB twin
(`calyx.plans.oracle`) can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from calyx.functions import exprs as X
from calyx.operators import collinearity as C
from calyx.operators import profile as P
from calyx.operators import sampling as S
from calyx.sources import fixtures as FX
from calyx.sources.tables import drop_columns, good_lines, load_table, require_columns

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # + 0.0 turns -0.0 into 0.0, as the oracle does
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# Feature groups used by the profiling queries.
CONT_FEATURES = ["age", "experience", "income", "family", "ccavg", "education", "mortgage"]
BOX_FEATURES = ["income", "ccavg", "mortgage", "family"]
LEVEL_CANDIDATES = ["age", "zip", "family", "education", "securities_account", "cd_account", "online", "creditcard"]
DUP_COLUMNS = ["family", "education", "securities_account", "cd_account", "online", "creditcard", "segment"]
HIGH_CORR_FEATURES = ["age", "experience", "income", "ccavg", "mortgage", "family"]
VIF3 = ["age", "experience", "income"]


# ---- A: sources -----------------------------------------------------------
@register("load_table")
def q_load_table(spark, sf):
    return load_table(spark, sf, "customer")


@register("load_table_csv")
def q_load_table_csv(spark, sf):
    """The customer table, written as CSV and read with its declared schema."""
    from calyx.operators.explain import scratch_path
    from calyx.sources.sinks import write_table
    path = write_table(load_table(spark, sf, "customer"), scratch_path(spark, "customer-csv"), "csv")
    return good_lines(load_table(spark, sf, "customer", "csv", path=path))[0]


@register("loan_base")
def q_loan_base(spark, sf):
    return FX.loan_base(spark, sf)


@register("require_columns")
def q_require_columns(spark, sf):
    return require_columns(FX.loan_base(spark, sf), FX.LOAN_FEATURES)


# ---- B: projections -------------------------------------------------------
@register("clip_lower")
def q_clip_lower(spark, sf):
    return FX.loan_base(spark, sf).select("id", F.col("experience").alias("experience_raw"),
                                          X.clip_lower("experience").alias("experience"))


@register("drop_columns")
def q_drop_columns(spark, sf):
    return drop_columns(FX.loan_base(spark, sf), ["id", "zip", "not_a_column"])


@register("ratio_guarded")
def q_ratio_guarded(spark, sf):
    return X.engineer_features(FX.loan_base(spark, sf)).select("id", "income_per_family")


@register("interactions")
def q_interactions(spark, sf):
    return X.engineer_features(FX.loan_base(spark, sf)).select("id", "income_x_education", "ccavg_x_income")


@register("ratio_smoothed")
def q_ratio_smoothed(spark, sf):
    return X.engineer_features(FX.loan_base(spark, sf)).select("id", "mortgage_to_income")


@register("bin_labels")
def q_bin_labels(spark, sf):
    return X.engineer_features(FX.loan_base(spark, sf)).select("id", "age", "income", "age_bin", "income_bin")


@register("infer_column_kinds")
def q_infer_column_kinds(spark, sf):
    df = X.engineer_features(FX.loan_base(spark, sf)).drop("id", "label")
    return spark.createDataFrame(X.infer_column_kinds(df), "column string, kind string")


# ---- C: profiling ---------------------------------------------------------
@register("table_shape")
def q_table_shape(spark, sf):
    return P.table_shape(FX.loan_base(spark, sf))


@register("missing_counts")
def q_missing_counts(spark, sf):
    return P.missing_counts(FX.loan_with_nulls(spark, sf))


@register("class_counts")
def q_class_counts(spark, sf):
    return rounded(P.class_counts(FX.loan_base(spark, sf)))


@register("class_weights")
def q_class_weights(spark, sf):
    return rounded(P.class_weights(FX.loan_base(spark, sf)))


@register("describe_table")
def q_describe_table(spark, sf):
    return rounded(P.describe_table(FX.loan_with_nulls(spark, sf), CONT_FEATURES))


@register("duplicate_rows")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(FX.loan_base(spark, sf), DUP_COLUMNS)


@register("boxplot_stats")
def q_boxplot_stats(spark, sf):
    return rounded(P.boxplot_stats(FX.loan_base(spark, sf), BOX_FEATURES))


@register("count_by_feature_class")
def q_count_by_feature_class(spark, sf):
    return P.count_by_feature_class(FX.loan_base(spark, sf), LEVEL_CANDIDATES)


@register("kde_by_class")
def q_kde_by_class(spark, sf):
    out = P.kde_by_class(FX.loan_base(spark, sf), "income")
    return out.select("label", "grid_index", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@register("corr_matrix")
def q_corr_matrix(spark, sf):
    return rounded(C.corr_matrix(FX.loan_base(spark, sf), CONT_FEATURES))


@register("corr_with_target")
def q_corr_with_target(spark, sf):
    return rounded(C.corr_with_target(FX.loan_base(spark, sf), CONT_FEATURES))


@register("drop_high_corr_pair")
def q_drop_high_corr_pair(spark, sf):
    return rounded(C.drop_high_corr_pair(FX.loan_base(spark, sf), "age", "experience"))


@register("high_corr_pairs")
def q_high_corr_pairs(spark, sf):
    return rounded(C.high_corr_pairs(FX.loan_base(spark, sf), HIGH_CORR_FEATURES))


@register("vif_table")
def q_vif_table(spark, sf):
    return rounded(C.vif_table(FX.loan_base(spark, sf), VIF3))


@register("vif_filter")
def q_vif_filter(spark, sf):
    base = X.engineer_features(FX.loan_base(spark, sf))
    split = S.stratified_split(base)
    train = split.where(F.col("split") == "train")
    cols = X.numeric_columns(train.drop("id", "label", "u", "p", "zip"))
    kept, dropped, table = C.vif_filter(train, cols, 10.0, protected=ST.VIF_PROTECTED)
    rows = [("dropped", d["feature"], float(d["vif"])) for d in dropped] + [("final", f, v) for f, v in table]
    return spark.createDataFrame(rows, "stage string, feature string, vif double")


# ---- D: splits and samples ------------------------------------------------
@register("stratified_split")
def q_stratified_split(spark, sf):
    return S.stratified_split(FX.loan_base(spark, sf)).select("id", "label", "split")


@register("three_way_split")
def q_three_way_split(spark, sf):
    return S.three_way_split(FX.loan_base(spark, sf)).select("id", "label", "split")


@register("kfold_ordered")
def q_kfold_ordered(spark, sf):
    return S.kfold(FX.loan_base(spark, sf), k=5, shuffle=False).select("id", "label", "fold")


@register("kfold_shuffled")
def q_kfold_shuffled(spark, sf):
    return S.kfold(FX.loan_base(spark, sf), k=5, shuffle=True, seed=42).select("id", "label", "fold")


@register("train_ratio_sweep")
def q_train_ratio_sweep(spark, sf):
    return S.train_ratio_sweep(FX.loan_base(spark, sf))


@register("learning_subsets")
def q_learning_subsets(spark, sf):
    folded = S.kfold(FX.loan_base(spark, sf), k=5, shuffle=True, seed=42).select("id", "label", "fold")
    return S.learning_subsets(folded)


@register("capped_class_sample")
def q_capped_class_sample(spark, sf):
    return S.capped_class_sample(FX.loan_base(spark, sf)).select("id", "label")


# ---- H / G on score tables ------------------------------------------------
from calyx.operators import evaluate as E  # noqa: E402

BASELINE_VARIANT, IMPROVED_VARIANT = "lr_planted", "LR_sqrt"


def _variants(spark, sf):
    return FX.score_variants(spark, sf)


@register("apply_threshold")
def q_apply_threshold(spark, sf):
    return _variants(spark, sf).withColumn("pred", X.apply_threshold("score", 0.5))


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return E.confusion(_variants(spark, sf), 0.5, ["variant"])


@register("basic_metrics")
def q_basic_metrics(spark, sf):
    m = E.with_basic_metrics(E.confusion(_variants(spark, sf), 0.5, ["variant"]))
    return rounded(m.select("variant", "accuracy", "precision", "recall", "f1"))


@register("classification_report")
def q_classification_report(spark, sf):
    return rounded(E.classification_report(_variants(spark, sf), 0.5, ["variant"]))


@register("weighted_f1")
def q_weighted_f1(spark, sf):
    rep = E.classification_report(_variants(spark, sf), 0.5, ["variant"])
    return rounded(rep.where(F.col("row") == "weighted avg").select("variant", F.col("f1").alias("weighted_f1")))


@register("roc_curve")
def q_roc_curve(spark, sf):
    return rounded(E.roc_curve(_variants(spark, sf), ["variant"]))


@register("roc_auc")
def q_roc_auc(spark, sf):
    return rounded(E.areas(_variants(spark, sf), ["variant"]).select("variant", "roc_auc"))


@register("pr_curve")
def q_pr_curve(spark, sf):
    return rounded(E.pr_curve(_variants(spark, sf), ["variant"]))


@register("pr_auc_trapezoid")
def q_pr_auc_trapezoid(spark, sf):
    return rounded(E.areas(_variants(spark, sf), ["variant"]).select("variant", "pr_auc"))


@register("average_precision")
def q_average_precision(spark, sf):
    return rounded(E.areas(_variants(spark, sf), ["variant"]).select("variant", "average_precision"))


@register("threshold_sweep")
def q_threshold_sweep(spark, sf):
    return rounded(E.threshold_sweep(_variants(spark, sf), ["variant"]))


@register("best_threshold")
def q_best_threshold(spark, sf):
    return rounded(E.best_thresholds(E.threshold_sweep(_variants(spark, sf), ["variant"]), ["variant"]))


@register("youden_j")
def q_youden_j(spark, sf):
    return rounded(E.threshold_sweep(_variants(spark, sf), ["variant"]).select("variant", "threshold", "youden_j"))


@register("calibration_curve")
def q_calibration_curve(spark, sf):
    return rounded(E.calibration_curve(_variants(spark, sf), 10, ["variant"]))


@register("brier")
def q_brier(spark, sf):
    return rounded(E.brier(_variants(spark, sf), ["variant"]))


@register("train_test_metrics")
def q_train_test_metrics(spark, sf):
    split = S.stratified_split(FX.loan_base(spark, sf)).select("id", "label", F.col("p").alias("score"), "split")
    return rounded(E.unpivot_metrics(E.metrics_table(split, 0.5, ["split"]), ["split"]))


@register("name_filter")
def q_name_filter(spark, sf):
    m = E.metrics_table(_variants(spark, sf), 0.5, ["variant"])
    return rounded(m.where(F.coalesce(F.lower("variant").contains("lr"), F.lit(False))))


@register("unpivot_metrics")
def q_unpivot_metrics(spark, sf):
    return rounded(E.unpivot_metrics(E.metrics_table(_variants(spark, sf), 0.5, ["variant"]), ["variant"]))


@register("rank_models")
def q_rank_models(spark, sf):
    return rounded(E.rank_models(E.metrics_table(_variants(spark, sf), 0.5, ["variant"])))


@register("compare_variants")
def q_compare_variants(spark, sf):
    m = E.metrics_table(_variants(spark, sf), 0.5, ["variant"])
    return rounded(E.compare_variants(m, BASELINE_VARIANT, IMPROVED_VARIANT))


@register("cv_summary")
def q_cv_summary(spark, sf):
    base = FX.loan_base(spark, sf)
    folded = S.kfold(base, k=5, shuffle=True, seed=42).select("id", "label", F.col("p").alias("score"), "fold")
    return rounded(E.cv_summary(folded))


# ---- E: encoders (fit on the train split, applied to every row) ------------
from calyx.operators import encode as EN  # noqa: E402


def _train_of(df: DataFrame) -> DataFrame:
    return S.stratified_split(df).where(F.col("split") == "train").drop("split")


@register("impute_median")
def q_impute_median(spark, sf):
    df = FX.loan_with_nulls(spark, sf)
    model = EN.MedianImputer(inputCols=["income", "ccavg"]).fit(_train_of(df))
    return rounded(model.transform(df).select("id", "income", "ccavg"))


@register("impute_mode")
def q_impute_mode(spark, sf):
    df = FX.loan_with_nulls(spark, sf)
    model = EN.ModeImputer(inputCols=["segment", "family"]).fit(_train_of(df))
    return model.transform(df).select("id", "segment", "family")


@register("standard_scale")
def q_standard_scale(spark, sf):
    df = FX.loan_base(spark, sf)
    model = EN.PopulationScaler(inputCols=["age", "experience", "income", "mortgage"]).fit(_train_of(df))
    return rounded(model.transform(df).select("id", "age", "experience", "income", "mortgage"))


@register("onehot_drop_first")
def q_onehot_drop_first(spark, sf):
    df = FX.loan_base(spark, sf)
    model = EN.DropFirstOneHot(inputCols=["segment"]).fit(_train_of(df).where(F.col("segment") != "MACHINERY"))
    out = model.transform(df)
    cols = model.outputCols()
    slot = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(cols))):
        slot = F.when(F.col(c) == 1.0, F.lit(i)).otherwise(slot)
    return out.select("id", "segment", slot.alias("slot"), F.lit(len(cols)).alias("n_slots"))


@register("onehot_full")
def q_onehot_full(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = FX.loan_base(spark, sf).withColumn("zip", F.col("zip").cast("string"))
    model = Pipeline(stages=EN.onehot_full_stages(["zip"])).fit(_train_of(df).where(F.col("zip") != "7"))
    arr = vector_to_array(F.col("zip__ohe"))
    out = model.transform(df).select("id", "zip", arr.alias("a"))
    slot = F.array_position(F.col("a"), 1.0)
    return out.select("id", F.col("zip").cast("int").alias("zip"),
                      F.when(slot > 0, slot - 1).cast("int").alias("slot"), F.size("a").alias("n_slots"))


def _assembled(spark, sf):
    from calyx.plans.studies import CATEGORICAL, NUMERIC, prepare_loan
    prep = prepare_loan(spark, sf)
    model = EN.preprocessor(None, NUMERIC, CATEGORICAL).fit(prep.train)
    return model.transform(prep.train), model.transform(prep.train.unionByName(prep.test))


@register("assemble_features")
def q_assemble_features(spark, sf):
    from pyspark.ml.functions import vector_to_array
    _, out = _assembled(spark, sf)
    return rounded(out.select("id", F.posexplode(vector_to_array("features")).alias("idx", "value")))


@register("feature_names")
def q_feature_names(spark, sf):
    _, out = _assembled(spark, sf)
    names = EN.feature_names(out)
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


@register("pca2")
def q_pca2(spark, sf):
    from pyspark.ml.feature import PCA
    train, _ = _assembled(spark, sf)
    pca = PCA(k=2, inputCol="features", outputCol="pcs").fit(train)
    ev = [float(x) for x in pca.explainedVariance]
    return spark.createDataFrame([(i, v) for i, v in enumerate(ev)] + [(-1, sum(ev))],
                                 "component int, explained_variance double")


# ---- D7 SMOTE ----------------------------------------------------------------
from calyx.operators import smote as SM  # noqa: E402

SMOTE_FEATURES = ["income", "ccavg", "mortgage"]


@register("smote")
def q_smote(spark, sf):
    return SM.smote(FX.loan_base(spark, sf), SMOTE_FEATURES, k=5, seed=42)


# ---- F / G / H16-18 / A6 / I: model studies (invariant-checked) ---------------
from calyx.plans import studies as ST  # noqa: E402

for _name, _fn in {
    "lr_baseline": ST.lr_baseline, "lr_elastic": ST.lr_elastic, "lr_balanced": ST.lr_balanced,
    "lr_smote": ST.lr_smote, "lr_settings_sweep": ST.lr_settings_sweep,
    "calibrate_platt": lambda s, d: ST._metrics(ST.calibrated_scores(s, d, "sigmoid"), "lr_sigmoid"),
    "calibrate_isotonic": lambda s, d: ST._metrics(ST.calibrated_scores(s, d, "isotonic"), "lr_isotonic"),
    "calibration_choice": ST.calibration_choice,
    "dt_baseline": ST.dt_baseline, "dt_depth_sweep": ST.dt_depth_sweep, "dt_smote": ST.dt_smote,
    "tree_nodes": ST.tree_nodes, "rf_fit": lambda s, d: ST.rf_fit(s, d)[0], "rf_smote": ST.rf_smote,
    "svm_linear": ST.svm_linear_metrics, "svm_rbf": ST.svm_rbf, "svm_probability": ST.svm_probability,
    "svm_smote": ST.svm_smote, "svm_margin_rows": ST.svm_margin_rows, "decision_grid": ST.decision_grid,
    "predict_class_proba": ST.predict_class_proba,
    "grid_search_lr": ST.grid_search_lr, "grid_search_dt": ST.grid_search_dt, "grid_search_rf": ST.grid_search_rf,
    "grid_search_svm": ST.grid_search_svm, "best_params": ST.best_params, "cv_summary_model": ST.cv_summary_model,
    "validation_curve": ST.validation_curve, "learning_curve": ST.learning_curve,
    "train_ratio_metrics": ST.train_ratio_metrics,
    "lr_coefficients": ST.lr_coefficients, "tree_importance": ST.tree_importance,
    "permutation_importance": ST.permutation_importance, "coef_selector": ST.coef_selector,
    "model_roundtrip": ST.model_roundtrip, "batch_score": ST.batch_score, "stream_score": ST.stream_score,
}.items():
    REGISTRY[_name] = _fn


@register("complete_rows")
def q_complete_rows(spark, sf):
    return ST.complete_rows(FX.loan_with_nulls(spark, sf))

for _name, _fn in {
    "run_summary": ST.lr_run_summary, "sink_roundtrip": lambda s, d: rounded(ST.sink_roundtrip(s, d)),
    "doc_quality": ST.doc_quality, "pca2_embeddings": ST.pca2_embeddings,
    "smote_embeddings": ST.smote_embeddings,
}.items():
    REGISTRY[_name] = _fn


@register("doc_class_counts")
def q_doc_class_counts(spark, sf):
    d = FX.doc_base(spark, sf)
    return d.groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.avg("chars_per_word"), 6).alias("mean_chars_per_word"))


from calyx.plans.lr_study import lr_study  # noqa: E402

REGISTRY["lr_study"] = lr_study


# ---- H18 with an expression scorer (SQL-checkable) -----------------------------------
from calyx.operators import explain as XPL  # noqa: E402
from calyx.operators import isotonic as ISO  # noqa: E402

PERM_FEATURES = ["income", "experience", "ccavg"]


def planted_rule():
    """Class 1 where the planted logit is >= 0 (the fixture's own decision rule)."""
    z = (F.col("income") / 20.0 + F.col("experience") / 40.0
         + F.when(F.col("segment") == "BUILDING", 1.0).otherwise(0.0) - 7.0)
    return (z >= 0).cast("int")


@register("permutation_importance_expr")
def q_permutation_importance_expr(spark, sf):
    df = FX.loan_base(spark, sf).select("id", "label", "segment", *PERM_FEATURES)
    return rounded(XPL.permutation_importance_expr(df, PERM_FEATURES, planted_rule, n_repeats=10, seed=42))


@register("isotonic_fit")
def q_isotonic_fit(spark, sf):
    """Isotonic calibration map of every score variant, on whole scores (F7 core)."""
    return rounded(ISO.isotonic_fitted(FX.score_variants(spark, sf), "score", "label", ["variant"]))
