"""Model selection (G1-G8): grids over deterministic folds, validation and
learning curves.

Folds come from `sampling.kfold`, so every candidate sees the same rows.
Fits run as Spark ML jobs; independent fits are submitted from a small
driver thread pool (like CrossValidator's `parallelism`) so the cluster
works on several at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions.exprs import apply_threshold
from calyx.operators import evaluate as E
from calyx.operators.models import margin, positive_probability
from calyx.operators.sampling import for_fits

#: Fits at once: an iteration of one is a short job, which waits for the driver more than for its tasks.
PARALLELISM = 8
#: Partitions of all folds that are fitted side by side; a matter of time, not of results.
FOLD_PARTITIONS = 16


def in_threads(spark: SparkSession, run: Callable, tasks: Sequence, parallelism: int = PARALLELISM) -> list:
    """run(task) for all tasks, in order.  Every call has job properties of its own: threads that share them lose each
    other's execution ids."""
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(partial(run, t))) for t in tasks]]


def evaluator(metric: str = "roc_auc"):
    """Grid scorer: ROC AUC on the class-1 probability, or F1 of class 1."""
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(rawPredictionCol="probability", metricName="areaUnderROC", numBins=0)
    if metric == "f1":
        return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(metricName="accuracy")
    raise ValueError(metric)


def grid_search(pipeline: Estimator, param_maps: list, folded: DataFrame, metric: str = "roc_auc",
                n_folds: int = 5, parallelism: int = PARALLELISM):
    """CrossValidator over the given fold column; the best map is the first
    maximum in grid order, refitted on all rows."""
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=param_maps, evaluator=evaluator(metric),
                        numFolds=n_folds, foldCol="fold", parallelism=parallelism, seed=42)
    return cv.fit(folded)


def grid_table(spark: SparkSession, cv_model, param_maps: list, metric: str) -> DataFrame:
    """(candidate, params, mean_score, std_score, is_best) from a fitted search."""
    best = max(range(len(cv_model.avgMetrics)), key=lambda i: (cv_model.avgMetrics[i], -i))
    rows = []
    for i, pm in enumerate(param_maps):
        desc = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        std = cv_model.stdMetrics[i] if getattr(cv_model, "stdMetrics", None) else None
        rows.append((i, desc, float(cv_model.avgMetrics[i]), None if std is None else float(std), i == best))
    return spark.createDataFrame(rows, "candidate int, params string, mean_score double, std_score double, "
                                       "is_best boolean").withColumn("metric", F.lit(metric))


def best_params(cv_model, param_maps: list) -> dict:
    best = max(range(len(cv_model.avgMetrics)), key=lambda i: (cv_model.avgMetrics[i], -i))
    return {p.name: v for p, v in param_maps[best].items()}


def _score_split(model, df: DataFrame, metric: str, threshold: float = 0.5) -> float:
    out = model.transform(df)
    if "probability" in out.columns:
        scored = positive_probability(out).select("label", "score")
    else:  # a margin classifier: its decision value, cut at 0
        scored, threshold = margin(out, out="score").select("label", "score"), 0.0
    if metric == "roc_auc":
        return E.areas(scored).first()["roc_auc"]
    m = E.with_basic_metrics(E.confusion(scored.withColumn("pred", apply_threshold("score", threshold)),
                                         pred="pred")).first()
    return m[metric]


def fold_scores(build: Callable[[object], Estimator], values: Sequence, folded: DataFrame, metric: str,
                n_folds: int = 5, parallelism: int = PARALLELISM) -> list[tuple]:
    """For each value and fold: fit on the other folds, score train and
    validation parts.  Returns (value, fold, split, score) tuples."""
    tasks = [(v, f) for v in values for f in range(n_folds)]

    def run(task):
        v, f = task
        train = folded.where(F.col("fold") != f)
        valid = folded.where(F.col("fold") == f)
        model = build(v).fit(train)
        return [(v, f, "train", float(_score_split(model, train, metric))),
                (v, f, "validation", float(_score_split(model, valid, metric)))]

    return [r for rows in in_threads(folded.sparkSession, run, tasks, parallelism) for r in rows]


def summarize_curve(spark: SparkSession, rows: list[tuple], value_name: str, value_type: str = "double") -> DataFrame:
    """Mean and population std over folds per (value, split)."""
    df = spark.createDataFrame(rows, f"{value_name} {value_type}, fold int, split string, score double")
    return df.groupBy(value_name, "split").agg(F.avg("score").alias("mean_score"),
                                               F.stddev_pop("score").alias("std_score"),
                                               F.count(F.lit(1)).alias("n_folds"))


def validation_curve(spark: SparkSession, build, values: Sequence, folded: DataFrame, metric: str,
                     value_name: str = "param") -> DataFrame:
    return summarize_curve(spark, fold_scores(build, values, folded, metric), value_name)


def learning_curve(spark: SparkSession, estimator: Estimator, subsets: DataFrame, folded: DataFrame,
                   metric: str, parallelism: int = PARALLELISM) -> DataFrame:
    """subsets: (cv_split, id, size_index, n_train) from `sampling.learning_subsets`;
    folded: the full rows with `fold`.  Fits one model per (split, size)."""
    keys = [(r["cv_split"], r["size_index"], r["n_train"])
            for r in subsets.select("cv_split", "size_index", "n_train").distinct().collect()]  # <= k x sizes rows

    def run(key):
        s, i, n = key
        ids = subsets.where((F.col("cv_split") == s) & (F.col("size_index") == i)).select("id")
        train = for_fits(folded.join(ids, "id"), n).persist()
        valid = folded.where(F.col("fold") == s)
        model = estimator.fit(train)
        found = [(float(n), s, "train", float(_score_split(model, train, metric))),
                 (float(n), s, "validation", float(_score_split(model, valid, metric)))]
        train.unpersist()
        return found

    rows = [r for rs in in_threads(spark, run, keys, parallelism) for r in rs]
    return summarize_curve(spark, rows, "n_train")


def encoded_fold_scores(spark: SparkSession, preprocessor: Estimator, estimator: Estimator, param_maps: list,
                        folded: DataFrame, metric: str = "roc_auc", n_folds: int = 5,
                        parallelism: int = PARALLELISM) -> list[list[float]]:
    """Each candidate's score in every fold.  Per fold the preprocessor is fitted on the train part once, and all
    candidates are fitted on the persisted encoded rows, in the partitions of `folded` (see `sampling.for_fits`).
    Folds of few partitions go side by side (see `folds_at_once`)."""
    from pyspark import StorageLevel
    ev = evaluator(metric)
    used = [estimator.getFeaturesCol(), estimator.getLabelCol(), *([estimator.getWeightCol()] if estimator.isDefined(estimator.weightCol) else [])]

    def fold(f):
        tr = folded.where(F.col("fold") != f)
        pre = preprocessor.copy().fit(tr)
        tr_enc = pre.transform(tr).select(*used).persist(StorageLevel.MEMORY_AND_DISK)
        va_enc = pre.transform(folded.where(F.col("fold") == f)).select(*used).persist(StorageLevel.MEMORY_AND_DISK)

        def fit_eval(pm):
            return float(ev.evaluate(estimator.copy(pm).fit(tr_enc).transform(va_enc)))

        found = in_threads(spark, fit_eval, param_maps, parallelism)  # candidates are independent jobs
        tr_enc.unpersist()
        va_enc.unpersist()
        return found

    by_fold = in_threads(spark, fold, range(n_folds), folds_at_once(folded, n_folds))
    return [list(scores) for scores in zip(*by_fold, strict=True)]


def folds_at_once(folded: DataFrame, n_folds: int) -> int:
    """How many folds are fitted side by side: an iteration's job on few partitions leaves most of a cluster idle, one on
    many partitions fills it, and its fold's encoded rows are large."""
    return max(1, min(n_folds, FOLD_PARTITIONS // max(1, folded.rdd.getNumPartitions())))


def grid_search_encoded(spark: SparkSession, preprocessor: Estimator, estimator: Estimator, param_maps: list,
                        folded: DataFrame, metric: str = "roc_auc", n_folds: int = 5,
                        parallelism: int = PARALLELISM, refit_maps: list | None = None):
    """Grid search when the grid does not touch the encoder.  `refit_maps`: the
    same candidates for the refit on all rows, where a parameter (a penalty)
    depends on the number of rows.  Returns
    (table like `grid_table`, best refitted PipelineModel-like pair)."""
    from pyspark.ml import PipelineModel
    scores = encoded_fold_scores(spark, preprocessor, estimator, param_maps, folded, metric, n_folds, parallelism)
    means = [sum(s) / len(s) for s in scores]
    stds = [(sum((x - m) ** 2 for x in s) / len(s)) ** 0.5 for s, m in zip(scores, means)]
    best = max(range(len(means)), key=lambda i: (means[i], -i))  # first maximum in grid order
    rows = []
    for i, pm in enumerate(param_maps):
        desc = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        rows.append((i, desc, means[i], stds[i], i == best))
    table = spark.createDataFrame(rows, "candidate int, params string, mean_score double, std_score double, "
                                        "is_best boolean").withColumn("metric", F.lit(metric))
    pre_all = preprocessor.fit(folded)
    best_model = estimator.copy((refit_maps or param_maps)[best]).fit(pre_all.transform(folded))
    return table, PipelineModel(stages=[*pre_all.stages, best_model])
