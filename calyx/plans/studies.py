"""End-to-end study plans: prepare -> split -> fit -> score -> evaluate.

Model fits are `pyspark.ml` jobs over the (persisted) train split; scoring
is a narrow `transform`; evaluation reads the resulting scores table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions.exprs import apply_threshold, clip_lower, missing_names
from calyx.operators import encode as EN
from calyx.operators import evaluate as E
from calyx.operators import models as M
from calyx.operators import profile as P
from calyx.operators import sampling as S
from calyx.session import cut_lineage
from calyx.sources import fixtures as FX

# The study's feature lists and seed.
NUMERIC = ["age", "experience", "income", "family", "ccavg", "education", "mortgage",
           "securities_account", "cd_account", "online", "creditcard"]
CATEGORICAL = ["segment"]
VIF_PROTECTED = {"income", "ccavg", "mortgage"}
SEED = 42


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    n_train: int
    sizes: dict = field(default_factory=dict)
    validation: DataFrame | None = None


def prepare_loan(spark: SparkSession, sf_dir: str, three_way: bool = False, weights: bool = False, deal: bool = True,
                 fit_rows: int = S.FIT_ROWS) -> Prepared:
    """Loan table with Experience clipped at 0, split by class, checkpointed: the plan behind a fit's rows goes with each of
    its iterations' jobs, so it is cut short.  Without `deal` the rows stay in the partitions they come in, persisted: a
    forest draws its trees' rows by partition."""
    base = FX.loan_base(spark, sf_dir).withColumn("experience", clip_lower("experience"))
    base = base.select("id", *NUMERIC, *CATEGORICAL, "label")
    sizes = S.class_sizes(base)
    split = S.three_way_split(base, sizes=sizes) if three_way else S.stratified_split(base, sizes=sizes)
    if weights:
        split = P.attach_weights(split, counted=F.col("split") == "train")
    split = cut_lineage(S.for_fits(split, sum(sizes.values()), fit_rows=fit_rows)) if deal else split.persist(StorageLevel.MEMORY_AND_DISK)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    val = split.where(F.col("split") == "validation").drop("split") if three_way else None
    n_train = train.count()
    return Prepared(train, test, n_train, sizes, val)


def lr_pipeline(C: float = 1.0, penalty: str = "l2", n_weight: float = 1.0, weight_col: str | None = None,
                numeric=NUMERIC, categorical=CATEGORICAL) -> Pipeline:
    pre = EN.preprocessor(None, numeric, categorical)
    return Pipeline(stages=[*pre.getStages(), M.logistic(C, penalty, n_weight, weight_col=weight_col)])


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5, keep=("id", "label")) -> DataFrame:
    out = M.positive_probability(model.transform(df))
    return out.select(*keep, "score").withColumn("pred", apply_threshold("score", threshold))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic-regression baseline: one metrics row on the test split."""
    prep = prepare_loan(spark, sf_dir)
    model = lr_pipeline(1.0, "l2", prep.n_train).fit(prep.train)
    scores = score(model, prep.test).withColumn("variant", F.lit("lr_baseline"))
    return E.metrics_table(scores, 0.5, ["variant"])


# ---- model families ------------------------------------------------------------
from pyspark.ml.feature import VectorAssembler  # noqa: E402

from calyx.operators import explain as XP  # noqa: E402
from calyx.operators import prefixes as PX  # noqa: E402
from calyx.operators import search as G  # noqa: E402
from calyx.operators import smote as SM  # noqa: E402


def _metrics(scores: DataFrame, variant: str, threshold: float = 0.5) -> DataFrame:
    return E.metrics_table(scores.withColumn("variant", F.lit(variant)), threshold, ["variant"])


def _margin_metrics(margins: DataFrame, variant: str) -> DataFrame:
    """Metrics of a margin classifier, cut at 0; a margin is no probability, so its Brier score is NULL."""
    return _metrics(margins.withColumnRenamed("margin", "score"), variant, 0.0).withColumn("brier", F.lit(None).cast("double"))


def raw_assembler(cols=NUMERIC, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out)


def lr_baseline(spark, sf):
    prep = prepare_loan(spark, sf)
    model = lr_pipeline(1.0, "l2", prep.n_train).fit(prep.train)
    return score(model, prep.test)


def lr_elastic(spark, sf, C: float = 2.0, penalty: str = "l1"):
    prep = prepare_loan(spark, sf)
    model = lr_pipeline(C, penalty, prep.n_train).fit(prep.train)
    return _metrics(score(model, prep.test), f"lr_{penalty}_C{C}")


def lr_balanced(spark, sf, C: float = 1.0):
    prep = prepare_loan(spark, sf, weights=True)
    # regParam scales with the total weight, as C multiplies the weighted loss
    total_w = prep.train.agg(F.sum("weight")).first()[0]
    model = lr_pipeline(C, "l2", total_w, weight_col="weight").fit(prep.train)
    return _metrics(score(model, prep.test), "lr_balanced")


def lr_smote(spark, sf, k: int = 5):
    prep = prepare_loan(spark, sf)
    pre = EN.preprocessor(None, NUMERIC, CATEGORICAL).fit(prep.train)
    enc_train = pre.transform(prep.train)
    resampled = SM.smote_vectors(enc_train, "features", "label", k=k, seed=SEED)
    n = resampled.count()
    clf = M.logistic(1.0, "l2", n).fit(resampled)
    out = M.positive_probability(clf.transform(pre.transform(prep.test))).select("id", "label", "score")
    return _metrics(out, "lr_smote")


# The five logistic-regression settings (C, class weight, threshold).
LR_SETTINGS = [("baseline", 1.0, None, 0.50), ("stronger_reg", 0.1, None, 0.50), ("weaker_reg", 5.0, None, 0.50),
               ("balanced_weight", 1.0, "balanced", 0.50), ("threshold_0.35", 1.0, None, 0.35)]


def lr_settings_sweep(spark, sf):
    prep = prepare_loan(spark, sf, weights=True)
    total_w = prep.train.agg(F.sum("weight")).first()[0]
    out = None
    for name, C, cw, t in LR_SETTINGS:
        wcol = "weight" if cw else None
        model = lr_pipeline(C, "l2", total_w if cw else prep.n_train, weight_col=wcol).fit(prep.train)
        m = _metrics(score(model, prep.test), name, t).withColumn("C", F.lit(C)) \
            .withColumn("class_weight", F.lit(cw or "None"))
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.col("f1").desc())


def _oof_margins(prep: Prepared, k: int = 5, C: float = 1.0):
    """Out-of-fold LR margins on the train split: (id, label, fold, margin),
    and the k fold models, fitted side by side."""
    folded = cut_lineage(S.kfold(prep.train, k=k, shuffle=False))

    def fit(f):
        return lr_pipeline(C, "l2", prep.n_train * (k - 1) / k).fit(folded.where(F.col("fold") != f))

    models = G.in_threads(folded.sparkSession, fit, range(k))
    parts = [M.margin(m.transform(folded.where(F.col("fold") == f))).select("id", "label", "fold", "margin") for f, m in enumerate(models)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return oof, models


def _calibrator(held: DataFrame, method: str, out: str):
    """Calibrator of one fold, fitted on its held-out margins."""
    if method == "sigmoid":
        return M.PlattCalibrator(inputCol="margin", outputCol=out).fit(held)
    return M.isotonic_model(held, "margin", "label").setFeaturesCol("margin").setPredictionCol(out)


def calibrated_columns(spark, sf, methods: list[str], k: int = 5, part: str = "test"):
    """(id, label, one column a method) of `part` (test or validation): per fold a model on the other folds and a
    calibrator of each method on its held-out margins; a score is the mean of the k calibrated probabilities (F6-F8),
    all from one pass over the rows."""
    prep = prepare_loan(spark, sf, three_way=True)
    oof, models = _oof_margins(prep, k)
    rows = prep.validation if part == "validation" else prep.test
    tasks = [(f, m) for f in range(k) for m in methods]
    fitted = dict(zip(tasks, G.in_threads(spark, lambda t: _calibrator(oof.where(F.col("fold") == t[0]), t[1], f"_{t[1]}{t[0]}"), tasks), strict=True))
    # the encoder scales in place: each model gets the features afresh from `row`
    out = rows.select("id", "label", F.struct(*NUMERIC, *CATEGORICAL).alias("row"))
    done = ["id", "label", "row"]
    for f, model in enumerate(models):
        out = M.margin(model.transform(out.select(*done, "row.*"))).select(*done, "margin")
        for m in methods:
            out = fitted[f, m].transform(out)
            done = [*done, f"_{m}{f}"]
        out = out.drop("margin")
    return out.select("id", "label", *[(sum(F.col(f"_{m}{f}") for f in range(k)) / k).alias(m) for m in methods])


def calibrated_scores(spark, sf, method: str = "isotonic", k: int = 5, part: str = "test"):
    """(id, label, score) of `part`, calibrated by one method."""
    return calibrated_columns(spark, sf, [method], k, part).withColumnRenamed(method, "score")


def calibration_choice(spark, sf):
    """Validation Brier of sigmoid and isotonic calibration, taken side by side; the lower wins, a tie goes to sigmoid."""
    methods = ["sigmoid", "isotonic"]
    found = G.in_threads(spark, lambda m: float(E.brier(calibrated_scores(spark, sf, m, part="validation")).first()["brier"]), methods)
    rows = [(m, b, rank) for rank, (m, b) in enumerate(zip(methods, found, strict=True))]
    df = spark.createDataFrame(rows, "method string, brier double, method_rank int")
    best = df.orderBy("brier", "method_rank").first()["method"]
    return df.withColumn("chosen", F.col("method") == F.lit(best)).drop("method_rank")


def tree_study(spark, sf, depth: int = 5, criterion: str = "gini", weights: bool = True, min_leaf: int = 5):
    prep = prepare_loan(spark, sf, weights=weights)
    asm = raw_assembler()
    dt = M.decision_tree(criterion, depth, min_leaf, weight_col="weight" if weights else None)
    model = Pipeline(stages=[asm, dt]).fit(prep.train)
    return prep, model


def dt_baseline(spark, sf):
    prep, model = tree_study(spark, sf)
    return _metrics(score(model, prep.test), "dt_baseline")


def dt_depth_sweep(spark, sf, depths=range(1, 16)):
    """Train and test accuracy at every depth, from one fit of the deepest tree."""
    prep = prepare_loan(spark, sf)
    asm = raw_assembler()
    train = asm.transform(prep.train).withColumn("part", F.lit("train"))
    both = train.unionByName(asm.transform(prep.test).withColumn("part", F.lit("test")))
    model = M.decision_tree("gini", max(depths), 1).fit(train)
    rows = [(c["max_depth"], c["part"], PX.accuracy(c)) for c in PX.depth_confusions(model, both, depths)]
    return spark.createDataFrame(rows, "max_depth int, split string, accuracy double")


def dt_smote(spark, sf):
    prep = prepare_loan(spark, sf)
    res = SM.smote_resample(prep.train, NUMERIC, k=5, seed=SEED,
                            keep_integers=["family", "education", "securities_account", "cd_account", "online", "creditcard"])
    res = P.attach_weights(res)
    model = Pipeline(stages=[raw_assembler(), M.decision_tree("gini", 5, 5, weight_col="weight")]).fit(res)
    return _metrics(score(model, prep.test), "dt_smote")


def tree_nodes(spark, sf):
    _, model = tree_study(spark, sf, depth=4, criterion="entropy", weights=False, min_leaf=1)
    return XP.tree_nodes(spark, model.stages[-1], NUMERIC)


def tree_importance(spark, sf):
    _, model = tree_study(spark, sf)
    return XP.tree_importance(spark, model.stages[-1], NUMERIC)


def rf_fit(spark, sf, n_trees: int = 200, depth: int = 7):
    prep = prepare_loan(spark, sf, deal=False)
    model = Pipeline(stages=[raw_assembler(), M.random_forest(n_trees, depth, "sqrt", 6)]).fit(prep.train)
    return _metrics(score(model, prep.test), "rf"), model, prep


def rf_smote(spark, sf):
    prep = prepare_loan(spark, sf, deal=False)
    asm = raw_assembler()
    rc = M.ResampledClassifier(M.random_forest(200, 7, "sqrt", 6), smoteK=3, smoteSeed=SEED)
    model = Pipeline(stages=[asm, rc]).fit(prep.train)
    return _metrics(score(model, prep.test), "rf_smote")


def svm_linear(spark, sf, C: float = 1.0):
    prep = prepare_loan(spark, sf, weights=True)
    total_w = prep.train.agg(F.sum("weight")).first()[0]
    pre = EN.preprocessor(None, NUMERIC, CATEGORICAL)
    model = Pipeline(stages=[*pre.getStages(), M.linear_svc(C, total_w, "weight")]).fit(prep.train)
    return prep, model


def svm_margin_scores(spark, sf, C: float = 1.0):
    prep, model = svm_linear(spark, sf, C)
    return M.margin(model.transform(prep.test)).select("id", "label", "margin"), prep, model


def svm_linear_metrics(spark, sf):
    s, _, _ = svm_margin_scores(spark, sf)
    # class from the sign of the margin; AUC etc. from the margin itself
    return _margin_metrics(s, "svm_linear")


def svm_probability(spark, sf):
    """Platt scaling of out-of-fold SVM margins (5 folds of the train split)."""
    prep = prepare_loan(spark, sf, weights=True)
    folded = cut_lineage(S.kfold(prep.train, k=5, shuffle=True, seed=SEED))

    def fit(f):
        """Model of the rows outside fold f, or of all."""
        rows = folded if f is None else folded.where(F.col("fold") != f)
        total_w = rows.agg(F.sum("weight")).first()[0]
        return Pipeline(stages=[*EN.preprocessor(None, NUMERIC, CATEGORICAL).getStages(), M.linear_svc(1.0, total_w, "weight")]).fit(rows)

    model, *models = G.in_threads(spark, fit, [None, *range(5)], 6)
    parts = [M.margin(m.transform(folded.where(F.col("fold") == f))).select("label", "margin") for f, m in enumerate(models)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    cal = M.PlattCalibrator(inputCol="margin", outputCol="score").fit(oof)
    test = cal.transform(M.margin(model.transform(prep.test)).select("id", "label", "margin"))
    return _metrics(test.select("id", "label", "score"), "svm_platt")


def svm_rbf(spark, sf, C: float = 10.0, n_components: int = 300):
    prep = prepare_loan(spark, sf, weights=True)
    pre = EN.preprocessor(None, NUMERIC, CATEGORICAL).fit(prep.train)
    tr = pre.transform(prep.train)
    p = len(EN.feature_names(tr))
    gamma = M.gamma_scale(tr, "features", p)
    rff = M.RandomFourierFeatures(inputCol="features", outputCol="rff", gamma=gamma, nComponents=n_components,
                                  nFeatures=p, seed=SEED)
    total_w = tr.agg(F.sum("weight")).first()[0]
    svc = M.linear_svc(C, total_w, "weight", features="rff").fit(rff.transform(tr))
    te = M.margin(svc.transform(rff.transform(pre.transform(prep.test)))).select("id", "label", "margin")
    return _margin_metrics(te, "svm_rbf_rff")


def svm_margin_rows(spark, sf):
    s, _, _ = svm_margin_scores(spark, sf)
    return XP.margin_rows(s)


def decision_grid(spark, sf, steps: int = 300):
    """2-feature linear SVM on scaled income and ccavg; decision value on a lattice."""
    prep = prepare_loan(spark, sf, weights=True)
    scaler = EN.PopulationScaler(inputCols=["income", "ccavg"]).fit(prep.train)
    tr = raw_assembler(["income", "ccavg"]).transform(scaler.transform(prep.train))
    total_w = tr.agg(F.sum("weight")).first()[0]
    svc = M.linear_svc(1.0, total_w, "weight").fit(tr)
    b = tr.agg(F.min("income"), F.max("income"), F.min("ccavg"), F.max("ccavg")).first()
    return XP.decision_grid(spark, {"income": (b[0], b[1]), "ccavg": (b[2], b[3])}, svc.coefficients.toArray(),
                            svc.intercept, steps, 1.0, ("income", "ccavg"))


def predict_class_proba(spark, sf):
    _, model, prep = rf_fit(spark, sf)
    return score(model, prep.test).select("id", F.col("pred").alias("predicted_class"), F.col("score").alias("proba"))


def lr_coefficients(spark, sf):
    prep = prepare_loan(spark, sf)
    model = lr_pipeline(1.0, "l1", prep.n_train).fit(prep.train)
    names = EN.feature_names(model.transform(prep.test.limit(1)))
    return XP.coefficients(spark, model.stages[-1], names, 15)


def coef_selector(spark, sf):
    """Keep features with a nonzero L1 coefficient; (feature, kept)."""
    prep = prepare_loan(spark, sf)
    model = lr_pipeline(0.05, "l1", prep.n_train).fit(prep.train)
    names = EN.feature_names(model.transform(prep.test.limit(1)))
    coefs = model.stages[-1].coefficients.toArray()
    return spark.createDataFrame([(n, bool(abs(c) > 0)) for n, c in zip(names, coefs)], "feature string, kept boolean")


def permutation_importance(spark, sf, n_repeats: int = 10):
    _, model, prep = rf_fit(spark, sf)
    return XP.permutation_importance(model, prep.test, NUMERIC, n_repeats=n_repeats, seed=SEED)


# ---- search -----------------------------------------------------------------------
def _folded_train(spark, sf, weights=False, fit_rows=S.FIT_ROWS):
    prep = prepare_loan(spark, sf, weights=weights, fit_rows=fit_rows)
    return prep, cut_lineage(S.kfold(prep.train, k=5, shuffle=False))


# The full search grids of the studies.
LR_GRID_C = (0.01, 0.05, 0.1, 0.5, 1, 2, 5, 10)
DT_GRID = {"criterion": ("gini", "entropy"), "max_depth": (4, 5, 6, 7, 8, None), "min_samples_leaf": (1, 2, 5, 10),
           "class_weight": (None, "balanced")}
RF_GRID = {"max_depth": (6, 7), "min_samples_leaf": (6, 8), "class_weight": (None, "balanced")}
SVM_GRID_C = (0.1, 1, 10)
SVM_GRID_GAMMA = ("scale", "auto", "0.01")


def grid_search_lr(spark, sf, Cs=LR_GRID_C, penalties=("l1", "l2")):
    prep, folded = _folded_train(spark, sf, fit_rows=S.NARROW_FIT_ROWS)
    lr = M.logistic(1.0, "l2", 1.0, max_iter=100)

    def maps(n):
        return [{lr.regParam: 1.0 / (C * n), lr.elasticNetParam: 1.0 if p == "l1" else 0.0} for p in penalties for C in Cs]
    table, _ = G.grid_search_encoded(spark, EN.preprocessor(None, NUMERIC, CATEGORICAL), lr, maps(prep.n_train * 4 / 5),
                                     folded, "roc_auc", refit_maps=maps(prep.n_train))
    return table


def _candidate_table(spark, scores: dict, metric: str) -> DataFrame:
    """(candidate, params, mean_score, std_score, is_best, metric) from each candidate's scores by fold, in grid order."""
    means = {c: sum(s) / len(s) for c, s in scores.items()}
    best = max(means.values())
    first = next(c for c in scores if means[c] == best)  # the first maximum in grid order
    rows = [(i, ", ".join(f"{k}={v}" for k, v in c), means[c], (sum((x - means[c]) ** 2 for x in s) / len(s)) ** 0.5, c == first)
            for i, (c, s) in enumerate(scores.items())]
    return spark.createDataFrame(rows, "candidate int, params string, mean_score double, std_score double, "
                                       "is_best boolean").withColumn("metric", F.lit(metric))


def _fold_parts(spark, sf, fit_rows=S.FIT_ROWS) -> list[DataFrame]:
    """Assembled train rows once for each fold, `part` telling the train from the validation rows, with class weights
    from the train rows."""
    _, folded = _folded_train(spark, sf, fit_rows=fit_rows)
    rows = raw_assembler().transform(folded)
    out = []
    for f in range(5):
        split = rows.withColumn("part", F.when(F.col("fold") == f, "validation").otherwise("train"))
        out.append(P.attach_weights(split, counted=F.col("part") == "train"))
    return out


def grid_search_dt(spark, sf, grid: dict | None = None):
    """The whole tree grid: one unlimited fit for each fold and setting other than the depth, scored at all depths.  A
    partition sends the statistics of all open nodes, so fits take large ones, and a row's node is kept from pass to pass."""
    grid = grid or DT_GRID
    deepest = None if None in grid["max_depth"] else max(grid["max_depth"])
    settings = [(c, m, w) for c in grid["criterion"] for m in grid["min_samples_leaf"] for w in grid["class_weight"]]
    scores = {(("criterion", c), ("max_depth", d), ("min_samples_leaf", m), ("class_weight", w)): []
              for c in grid["criterion"] for d in grid["max_depth"] for m in grid["min_samples_leaf"] for w in grid["class_weight"]}

    for parts in _fold_parts(spark, sf, S.NARROW_FIT_ROWS):
        parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
        train = parts.where("part = 'train'")

        def fit(setting, parts=parts, train=train):
            criterion, leaf, weighted = setting
            weight = "weight" if weighted else None
            model = M.decision_tree(criterion, deepest, leaf, weight_col=weight).setCacheNodeIds(True).fit(train)
            return setting, PX.depth_confusions(model, parts, grid["max_depth"], weight=weight)

        for (criterion, leaf, weighted), found in G.in_threads(spark, fit, settings):
            for cells in found:
                if cells["part"] == "validation":
                    scores[("criterion", criterion), ("max_depth", cells["max_depth"]), ("min_samples_leaf", leaf), ("class_weight", weighted)].append(PX.f1(cells))
        parts.unpersist()
    return _candidate_table(spark, scores, "f1")


def grid_search_rf(spark, sf, grid: dict | None = None, n_trees: int = 200):
    """The whole forest grid: one fit of the deepest forest for each fold and setting other than the depth."""
    grid = grid or RF_GRID
    depths = list(grid["max_depth"])
    scores = {(("max_depth", d), ("min_samples_leaf", m), ("class_weight", w)): []
              for d in depths for m in grid["min_samples_leaf"] for w in grid["class_weight"]}
    settings = [(leaf, weighted) for leaf in grid["min_samples_leaf"] for weighted in grid["class_weight"]]
    folds = [parts.persist(StorageLevel.MEMORY_AND_DISK) for parts in _fold_parts(spark, sf)]

    def fit(task):
        parts, (leaf, weighted) = task
        model = M.random_forest(n_trees, max(depths), "sqrt", leaf, weight_col="weight" if weighted else None).fit(parts.where("part = 'train'"))
        return leaf, weighted, PX.forest_confusions(model, parts.where("part = 'validation'"), [(n_trees, d) for d in depths])

    for leaf, weighted, found in G.in_threads(spark, fit, [(parts, setting) for parts in folds for setting in settings]):
        for cells in found:
            scores[("max_depth", cells["max_depth"]), ("min_samples_leaf", leaf), ("class_weight", weighted)].append(PX.f1(cells))
    for parts in folds:
        parts.unpersist()
    return _candidate_table(spark, scores, "f1")


def grid_search_svm(spark, sf, Cs=SVM_GRID_C, gammas=SVM_GRID_GAMMA):
    """The whole SVM grid: linear, and RBF for every gamma (on its kernel features, made anew in each fold)."""
    _, folded = _folded_train(spark, sf, weights=True)
    total_w = folded.agg(F.sum("weight")).first()[0]
    scores = {}
    def kernel_scores(setting):
        kernel, gamma = setting
        stages = EN.preprocessor(None, NUMERIC, CATEGORICAL).getStages()
        if gamma:
            stages = [*stages, M.FourierKernel(gamma=gamma)]
        svc = M.linear_svc(1.0, total_w, "weight", max_iter=50, features="rff" if gamma else "features")
        maps = [{svc.regParam: 1.0 / (C * total_w * 4 / 5)} for C in Cs]
        return G.encoded_fold_scores(spark, Pipeline(stages=stages), svc, maps, folded, "f1")

    settings = [("linear", None), *[("rbf", g) for g in gammas]]
    at_once = len(settings) if G.folds_at_once(folded, 5) == 5 else 1  # a small table's kernels are fitted side by side
    for (kernel, gamma), found in zip(settings, G.in_threads(spark, kernel_scores, settings, at_once), strict=True):
        scores.update(((("kernel", kernel), ("C", C), ("gamma", gamma)), s) for C, s in zip(Cs, found, strict=True))
    return _candidate_table(spark, scores, "f1")


def best_params(spark, sf):
    """The winning candidate of the tree grid (first maximum in grid order)."""
    return grid_search_dt(spark, sf).where("is_best")


def cv_summary_model(spark, sf):
    """Out-of-fold predictions of the tuned tree once, then per-fold metrics."""
    prep, folded = _folded_train(spark, sf)
    parts = []
    for f in range(5):
        m = Pipeline(stages=[raw_assembler(), M.decision_tree("entropy", 4, 1)]).fit(folded.where(F.col("fold") != f))
        parts.append(score(m, folded.where(F.col("fold") == f), keep=("id", "label", "fold")))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return E.cv_summary(oof)


def validation_curve_svm(spark, sf, Cs=(0.1, 1.0, 10.0, 50.0)):
    prep, folded = _folded_train(spark, sf)
    n = prep.n_train * 4 / 5

    def build(C):
        return Pipeline(stages=[*EN.preprocessor(None, NUMERIC, CATEGORICAL).getStages(),
                                M.linear_svc(C, n)])
    return G.validation_curve(spark, build, Cs, folded, "accuracy", "C")


# The numbers of trees of the forest curve.
FOREST_SIZES = (50, 100, 150, 200, 300)


def validation_curve_rf(spark, sf, trees=FOREST_SIZES):
    """F1 of train and validation rows by number of trees, from one forest a fold."""
    def curve(task):
        f, parts = task
        parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
        model = M.random_forest(max(trees), 7, "sqrt", 6).fit(parts.where("part = 'train'"))
        found = [(float(c["n_trees"]), f, c["part"], PX.f1(c)) for c in PX.forest_confusions(model, parts, [(t, None) for t in trees])]
        parts.unpersist()
        return found

    rows = [r for found in G.in_threads(spark, curve, list(enumerate(_fold_parts(spark, sf)))) for r in found]
    return G.summarize_curve(spark, rows, "n_estimators")


# The shares of the train rows in the learning curves.
LEARNING_SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)


def learning_curve(spark, sf, shares=LEARNING_SHARES, n_trees: int = 200):
    """Scores of train and validation rows by train size: F1 of the forest, accuracy of the linear SVM."""
    prep = prepare_loan(spark, sf, weights=True)
    folded = cut_lineage(S.kfold(prep.train, k=5, shuffle=True, seed=SEED))
    subsets = S.learning_subsets(folded.select("id", "label", "fold"), fracs=shares).persist(StorageLevel.MEMORY_AND_DISK)
    total_w = folded.agg(F.sum("weight")).first()[0] * 4 / 5
    forest = Pipeline(stages=[raw_assembler(), M.random_forest(n_trees, 7, "sqrt", 6)])
    svm = Pipeline(stages=[*EN.preprocessor(None, NUMERIC, CATEGORICAL).getStages(), M.linear_svc(1.0, total_w, "weight")])
    curves = [G.learning_curve(spark, est, subsets, folded, metric).withColumn("study", F.lit(study))
              for study, est, metric in (("forest_f1", forest, "f1"), ("svm_accuracy", svm, "accuracy"))]
    subsets.unpersist()
    return curves[0].unionByName(curves[1])


def train_ratio_metrics(spark, sf, ratios=(0.5, 0.6, 0.7, 0.8)):
    """Fit and test per train ratio of the sweep."""
    base = FX.loan_base(spark, sf).withColumn("experience", clip_lower("experience")) \
        .select("id", *NUMERIC, *CATEGORICAL, "label")
    sw = S.train_ratio_sweep(base, ratios=ratios).join(base.drop("label"), "id").persist()
    out = None
    for r in ratios:
        part = sw.where(F.col("train_ratio") == r)
        tr, te = part.where("split = 'train'"), part.where("split = 'test'")
        n = tr.count()
        model = lr_pipeline(1.0, "l2", n).fit(tr)
        m = _metrics(score(model, te), f"ratio_{r}").withColumn("train_ratio", F.lit(r)) \
            .withColumn("train_samples", F.lit(n))
        out = m if out is None else out.unionByName(m)
    return out


# ---- persistence and scoring ------------------------------------------------------
SCORE_COLUMNS = ["age", "experience", "income", "family", "ccavg", "education", "mortgage",
                 "securities_account", "cd_account", "online", "creditcard", "segment"]


def saved_model(spark, sf) -> tuple[str, PipelineModel, Prepared]:
    prep = prepare_loan(spark, sf)
    model = lr_pipeline(1.0, "l2", prep.n_train).fit(prep.train)
    path = XP.scratch_path(spark, "lr-pipeline")
    model.write().overwrite().save(path)
    return path, model, prep


def model_roundtrip(spark, sf):
    path, model, prep = saved_model(spark, sf)
    again = PipelineModel.load(path)
    a = score(model, prep.test).select("id", "label", F.col("score").alias("score_before"))
    b = score(again, prep.test).select("id", F.col("score").alias("score_after"))
    return a.join(b, "id").withColumn("equal", F.col("score_before") == F.col("score_after"))


def batch_score(spark, sf, path: str | None = None, df: DataFrame | None = None):
    """Load a saved pipeline, check and order the input columns, clip experience,
    append the predicted class and the class-1 probability."""
    from calyx.sources.tables import require_columns
    if path is None:
        path, _, _ = saved_model(spark, sf)
    model = PipelineModel.load(path)
    src = df if df is not None else FX.loan_base(spark, sf)
    inp = require_columns(src, ["id", *SCORE_COLUMNS]).withColumn("experience", clip_lower("experience"))
    out = M.positive_probability(model.transform(inp), out="_p")
    return out.select("id", *SCORE_COLUMNS, apply_threshold("_p", 0.5).alias("Predicted Class"),
                      F.col("_p").alias("Probability Personal Loan = 1"))


def complete_rows(df: DataFrame, cols=SCORE_COLUMNS, id_col: str = "id") -> DataFrame:
    """Per row: number of missing feature values and their names; complete rows
    go on to scoring, the others to a rejects table."""
    missing = missing_names(cols)
    n = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.select(id_col, n.alias("n_missing"), missing.alias("missing_columns"),
                     F.when(n == 0, "complete").otherwise("rejected").alias("status"))


def svm_smote(spark, sf, C: float = 2.0):
    """Encode -> SMOTE(k=3) on the train split only -> linear SVM."""
    prep = prepare_loan(spark, sf)
    pre = EN.preprocessor(None, NUMERIC, CATEGORICAL).fit(prep.train)
    res = SM.smote_vectors(pre.transform(prep.train), "features", "label", k=3, seed=SEED)
    res = cut_lineage(res.repartition(max(1, 2 * prep.n_train // S.FIT_ROWS)))  # resampled once, not for the count and the fit
    n = res.count()
    svc = M.linear_svc(C, n).fit(res)
    te = M.margin(svc.transform(pre.transform(prep.test))).select("id", "label", "margin")
    return _margin_metrics(te, "svm_smote")


def validation_curve(spark, sf):
    a = validation_curve_svm(spark, sf).withColumnRenamed("C", "param").withColumn("study", F.lit("C_accuracy"))
    b = validation_curve_rf(spark, sf).withColumnRenamed("n_estimators", "param") \
        .withColumn("study", F.lit("n_estimators_f1"))
    return a.unionByName(b)


def stream_score(spark, sf):
    """The loan table, some of its values missing, as a file stream: complete rows are scored by the saved pipeline, the
    others rejected with the names of what they lack."""
    from calyx.streaming.score_stream import run_to_completion, score_stream
    path, _, _ = saved_model(spark, sf)
    src, ckpt, out, rejects = (XP.scratch_path(spark, f"stream-{n}") for n in ("src", "ckpt", "out", "rejects"))
    FX.loan_with_nulls(spark, sf).select("id", *SCORE_COLUMNS).write.mode("overwrite").parquet(src)
    q = score_stream(spark, path, src, spark.read.parquet(src).schema, SCORE_COLUMNS, ckpt, out, rejects)
    scored, rejected = run_to_completion(spark, q, out, rejects)
    scored = scored.withColumn("status", F.lit("scored")).withColumn("missing_columns", F.lit(""))
    return scored.unionByName(rejected.withColumn("status", F.lit("rejected")), allowMissingColumns=True)


def lr_run_summary(spark, sf):
    """LR study summary: params, features dropped by the correlation and VIF
    rules on the train split, and train/test metrics of the model on the
    features that are left (written as JSON)."""
    from calyx.functions.exprs import engineer_features, numeric_columns
    from calyx.operators import collinearity as CO
    from calyx.sources.sinks import run_summary, write_table
    prep = prepare_loan(spark, sf)
    pair = CO.drop_high_corr_pair(prep.train, "age", "experience").first()
    eng = engineer_features(prep.train)
    cols = [c for c in numeric_columns(eng.drop("id", "label")) if c != pair["dropped"]]
    kept, vif_dropped, _ = CO.vif_filter(eng, cols, 10.0, protected=VIF_PROTECTED)
    dropped = [d for d in [pair["dropped"]] if d] + [d["feature"] for d in vif_dropped]
    model = lr_pipeline(1.0, "l2", prep.n_train, numeric=kept, categorical=[*CATEGORICAL, "age_bin", "income_bin"]).fit(eng)
    both = score(model, eng).withColumn("split", F.lit("train")).unionByName(
        score(model, engineer_features(prep.test)).withColumn("split", F.lit("test")))
    metrics = E.metrics_table(both, 0.5, ["split"])
    summary = run_summary(spark, "logistic_regression", {"C": 1.0, "penalty": "l2", "threshold": 0.5},
                          dropped, metrics)
    path = write_table(summary, XP.scratch_path(spark, "run-summary"), "json")
    return spark.read.json(path)


def sink_roundtrip(spark, sf):
    """Metrics table written as CSV and parquet and read back."""
    from calyx.sources.sinks import write_table
    m = E.metrics_table(FX.score_variants(spark, sf), 0.5, ["variant"])
    p1 = write_table(m, XP.scratch_path(spark, "metrics-csv"), "csv")
    p2 = write_table(m, XP.scratch_path(spark, "metrics-parquet"), "parquet")
    a = spark.read.option("header", True).option("inferSchema", True).csv(p1).select("variant", F.col("f1").alias("f1_csv"))
    b = spark.read.parquet(p2).select("variant", F.col("f1").alias("f1_parquet"))
    return a.join(b, "variant")


# ---- real labels: documents and embeddings ------------------------------------------
DOC_NUMERIC = ["n_chars", "n_words", "chars_per_word", "distinct_word_ratio"]
DOC_CATEGORICAL = ["lang", "source"]


def doc_features(spark, sf) -> DataFrame:
    """doc_base plus the share of distinct words over the whole text (JVM-side
    split / array_distinct, no Python)."""
    docs = FX.load_table(spark, sf, "documents").select("doc_id", "text")
    words = F.split(F.lower(F.trim(F.col("text"))), r"\s+")
    ratio = (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("distinct_word_ratio")
    return FX.doc_base(spark, sf).join(docs.select("doc_id", ratio), "doc_id")


def doc_quality(spark, sf):
    """LR on document shape features and language/source to flag low quality."""
    docs = doc_features(spark, sf).withColumnRenamed("doc_id", "id") \
        .withColumn("label", F.when(F.col("quality") == 0, 1).otherwise(0))
    sizes = S.class_sizes(docs)
    split = S.stratified_split(docs, sizes=sizes).persist()
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    n = train.count()
    pipe = Pipeline(stages=[*EN.preprocessor(None, DOC_NUMERIC, DOC_CATEGORICAL).getStages(), M.logistic(1.0, "l2", n)])
    model = pipe.fit(train)
    return _metrics(score(model, test), "doc_low_quality_lr")


def pca2_embeddings(spark, sf):
    """Two principal components of the embedding vectors: explained variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    emb = FX.vec_base(spark, sf).select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    pca = PCA(k=2, inputCol="features", outputCol="pcs").fit(emb)
    ev = [float(x) for x in pca.explainedVariance]
    return spark.createDataFrame([(i, v) for i, v in enumerate(ev)], "component int, explained_variance double")


def smote_embeddings(spark, sf):
    """SMOTE on 64-dimensional embeddings (label 0 vs rest): class counts after."""
    emb = FX.vec_base(spark, sf)
    cols = [f"e{i}" for i in range(64)]
    wide = emb.select("id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    res = SM.smote_resample(wide, cols, k=5, seed=SEED)
    return res.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))
