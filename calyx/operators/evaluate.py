"""Evaluation over a scores table.

Input: a DataFrame with optional group columns (variant, split, fold, ...),
a 0/1 `label` and a numeric `score`.  Everything is an aggregation:

* threshold metrics: one pass of conditional sums per group;
* curves and areas: aggregate to distinct (group, score) rows first - ties in
  the data collapse there, so a score shared by a third of the rows is one
  row - then running sums with `running_sums` (bucketed, no single-task window);
* threshold sweep and calibration: score bins with exact edges,
  one aggregate over at most 101 bins per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.operators.ranking import running_sums, with_totals
from calyx.session import cut_lineage


def _div(num: Column, den: Column, zero: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(zero)).otherwise(num / den)


def confusion(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = (),
              label: str = "label", score: str = "score", pred: str | None = None) -> DataFrame:
    """(group..., tn, fp, fn, tp).  Class 1 when score >= threshold, or from `pred`."""
    p = F.col(pred) == 1 if pred else F.col(score) >= F.lit(float(threshold))
    y = F.col(label) == 1
    s = lambda c: F.sum(c.cast("bigint"))
    return scores.groupBy(*group_cols).agg(s(~p & ~y).alias("tn"), s(p & ~y).alias("fp"),
                                           s(~p & y).alias("fn"), s(p & y).alias("tp"))


def with_basic_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from counts; zero denominators give 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return conf.select("*", _div(tn + tp, n).alias("accuracy"), _div(tp, tp + fp).alias("precision"),
                       _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = (),
                          label: str = "label", score: str = "score", pred: str | None = None) -> DataFrame:
    """Rows per class plus 'accuracy', 'macro avg', 'weighted avg':
    (group..., row, precision, recall, f1, support); accuracy has only f1."""
    c = confusion(scores, threshold, group_cols, label, score, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1_1 = _div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"), s.cast("bigint").alias("support"))

    rows = F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None), F.lit(None), _div(tn + tp, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n), _div(f1_0 * s0 + f1_1 * s1, n), n))
    return c.select(*group_cols, F.explode(rows).alias("r")).select(*group_cols, "r.*")


def score_counts(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
                 score: str = "score") -> DataFrame:
    """Distinct (group, score) with positive and negative counts, and the
    inclusive counts at or above each score (tp, fp if thresholded there)."""
    hist = scores.groupBy(*group_cols, score).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    # the distinct-score table feeds the cut points, offsets, windows and
    # totals: materialise it once (shared checkpoint folder) so the scores'
    # lineage runs once
    hist = cut_lineage(hist)
    cum = running_sums(hist, list(group_cols), score, ["pos", "neg"], descending=True)
    return with_totals(cum, hist, group_cols, {"P": "pos", "N": "neg"}).withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def roc_curve(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
              score: str = "score") -> DataFrame:
    """(group..., threshold, fpr, tpr) at every distinct score, and the start
    (0, 0) above all scores, whose threshold is null."""
    sc = score_counts(scores, group_cols, label, score)
    start = _ends(sc, group_cols).select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(sc.select(*group_cols, F.col(score).cast("double").alias("threshold"),
                     _div(F.col("fp"), F.col("N")).alias("fpr"), _div(F.col("tp"), F.col("P")).alias("tpr")))


def _ends(sc: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """One row per group of a curve (none if there are no scores)."""
    return sc.select(*group_cols).distinct() if group_cols else sc.select("P").limit(1)


def pr_curve(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
             score: str = "score") -> DataFrame:
    """(group..., threshold, precision, recall) at every distinct score, and the
    end (precision 1, recall 0) above all scores, whose threshold is null."""
    sc = score_counts(scores, group_cols, label, score)
    end = _ends(sc, group_cols).select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                                       F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return end.unionByName(sc.select(*group_cols, F.col(score).cast("double").alias("threshold"),
                                     _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                                     _div(F.col("tp"), F.col("P")).alias("recall")))


def _area_aggs(score: str) -> list[Column]:
    """Aggregates over score_counts rows: ROC AUC numerator (ties count half),
    PR-curve trapezoid (starting at recall 0, precision 1) and AP numerators."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    prec = _div(tp, tp + fp)
    tp0, fp0 = tp - pos, fp - neg
    prec_prev = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    return [F.sum(neg * (tp0 + 0.5 * pos)).alias("_auc"),
            F.sum(pos * (prec + prec_prev) / 2).alias("_prauc"),
            F.sum(pos * prec).alias("_ap")]


def _area_cols() -> list[Column]:
    return [_div(F.col("_auc"), F.col("P") * F.col("N"), float("nan")).alias("roc_auc"),
            _div(F.col("_prauc"), F.col("P")).alias("pr_auc"),
            _div(F.col("_ap"), F.col("P")).alias("average_precision")]


def areas(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
          score: str = "score") -> DataFrame:
    """(group..., roc_auc, pr_auc, average_precision).

    ROC AUC counts ties as half; PR AUC is the trapezoid over the PR curve that
    starts at (recall 0, precision 1); AP = sum of recall steps x precision.
    Each is a sum over distinct scores, so no lag across buckets is needed.
    """
    sc = score_counts(scores, group_cols, label, score)
    agg = sc.groupBy(*group_cols, "P", "N").agg(*_area_aggs(score))
    return agg.select(*group_cols, *_area_cols())


def brier(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    d = F.col(score) - F.col(label)
    return scores.groupBy(*group_cols).agg(F.avg(d * d).alias("brier"))


def metrics_table(scores: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = (),
                  label: str = "label", score: str = "score") -> DataFrame:
    """One row per group: threshold, accuracy, precision, recall, f1, roc_auc,
    pr_auc, average_precision, brier, tn, fp, fn, tp.

    Everything is one aggregation over the distinct-score table: the counts at
    the threshold are sums over scores >= t, the Brier score is
    sum(pos (s-1)^2 + neg s^2) / n - so the raw scores are read once.
    """
    if not group_cols:
        return metrics_table(scores.withColumn("_g", F.lit(0)), threshold, ["_g"], label, score).drop("_g")
    g = list(group_cols)
    sc = score_counts(scores, g, label, score)
    s, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    above = s >= F.lit(float(threshold))
    agg = sc.groupBy(*g, "P", "N").agg(
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"), F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("_sq"), *_area_aggs(score))
    base = agg.select("*", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    base = with_basic_metrics(base)
    return base.select(*g, F.lit(float(threshold)).alias("threshold"), "accuracy", "precision", "recall", "f1",
                       *_area_cols(), (F.col("_sq") / (F.col("P") + F.col("N"))).alias("brier"),
                       F.col("tn").cast("bigint").alias("tn"), F.col("fp").cast("bigint").alias("fp"),
                       F.col("fn").cast("bigint").alias("fn"), F.col("tp").cast("bigint").alias("tp"))


# The threshold grid 0.05..0.95 in steps of 0.01, as integer hundredths.
SWEEP_FROM, SWEEP_TO = 5, 95


def threshold_sweep(scores: DataFrame, group_cols: Sequence[str] = (), label: str = "label",
                    score: str = "score", lo: int = SWEEP_FROM, hi: int = SWEEP_TO) -> DataFrame:
    """(group..., threshold, precision, recall, f1, youden_j) for thresholds
    lo/100..hi/100.  A score's bin is the number of hundredths it reaches
    (score >= i/100 iff bin >= i, compared as doubles, nothing rounded), so the
    data is read once and the grid is answered from at most 101 bins per group."""
    if not group_cols:
        return threshold_sweep(scores.withColumn("_g", F.lit(0)), ["_g"], label, score, lo, hi).drop("_g")
    g = list(group_cols)
    near = F.floor(F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)) * 100)
    up, down = F.col(score) >= (near + 1) / F.lit(100.0), F.col(score) < near / F.lit(100.0)
    b = F.least(F.greatest(near + up.cast("int") - down.cast("int"), F.lit(0)), F.lit(100)).cast("int")
    hist = scores.groupBy(*g, b.alias("_b")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    tot = hist.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*g, "P", "N", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_i"))
    # both sides are bounded per group (<= 91 grid points x <= 101 bins)
    j = grid.join(hist, g).where(F.col("_b") >= F.col("_i"))
    c = j.groupBy(*g, "_i", "P", "N").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    full = grid.join(c, [*g, "_i", "P", "N"], "left").fillna(0, ["tp", "fp"])
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("P"), F.col("N")
    fn = P - tp
    return full.select(*g, (F.col("_i") / 100.0).alias("threshold"),
                       _div(tp, tp + fp).alias("precision"), _div(tp, P).alias("recall"),
                       _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                       (_div(tp, P) - fp / F.greatest(N, F.lit(1))).alias("youden_j"))


def best_thresholds(sweep: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group: threshold of max F1 (then max recall, then lowest threshold)
    and of max Youden J (then lowest threshold)."""
    g = list(group_cols)
    w1 = Window.partitionBy(*g).orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("threshold"))
    w2 = Window.partitionBy(*g).orderBy(F.col("youden_j").desc(), F.col("threshold"))
    # windows over the <= 91 sweep rows of each group
    r = sweep.select("*", F.row_number().over(w1).alias("_r1"), F.row_number().over(w2).alias("_r2"))
    return r.groupBy(*g).agg(
        F.max(F.when(F.col("_r1") == 1, F.col("threshold"))).alias("best_f1_threshold"),
        F.max(F.when(F.col("_r1") == 1, F.col("f1"))).alias("best_f1"),
        F.max(F.when(F.col("_r2") == 1, F.col("threshold"))).alias("best_j_threshold"),
        F.max(F.when(F.col("_r2") == 1, F.col("youden_j"))).alias("best_j"))


def calibration_curve(scores: DataFrame, n_bins: int = 10, group_cols: Sequence[str] = (),
                      label: str = "label", score: str = "score") -> DataFrame:
    """Uniform bins on [0,1]; a score on an inner edge falls in the lower bin;
    empty bins are absent.  (group..., bin, mean_predicted, fraction_positive, n)."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]  # evenly spaced doubles, compared as they are
    b = sum(((F.col(score) > e).cast("int") for e in edges), F.lit(0))
    return scores.groupBy(*group_cols, b.alias("bin")).agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))


METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "average_precision", "brier"]


def unpivot_metrics(metrics: DataFrame, id_cols: Sequence[str], names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Wide metric rows to (id..., metric, value)."""
    return metrics.unpivot(list(id_cols), [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def rank_models(metrics: DataFrame, name_col: str = "variant") -> DataFrame:
    """Sort by F1, ROC AUC, recall (all descending), then name; rank 1 = best.
    The window runs over the metrics table (one row per model)."""
    w = Window.orderBy(F.col("f1").desc(), F.col("roc_auc").desc(), F.col("recall").desc(), F.col(name_col))
    return metrics.withColumn("rank", F.row_number().over(w))


def compare_variants(metrics: DataFrame, baseline: str, improved: str, name_col: str = "variant",
                     names: Sequence[str] = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")) -> DataFrame:
    """(metric, baseline, improved, delta) incl. false-negative and false-positive counts."""
    cols = list(names) + ["fn", "fp"]
    long = metrics.where(F.col(name_col).isin(baseline, improved)).unpivot(
        [name_col], [F.col(c).cast("double").alias(c) for c in cols], "metric", "value")
    piv = long.groupBy("metric").pivot(name_col, [baseline, improved]).agg(F.first("value"))
    return piv.select("metric", F.col(f"`{baseline}`").alias("baseline"), F.col(f"`{improved}`").alias("improved"),
                      (F.col(f"`{improved}`") - F.col(f"`{baseline}`")).alias("delta"))


def cv_summary(fold_scores: DataFrame, threshold: float = 0.5, fold_col: str = "fold",
               label: str = "label", score: str = "score") -> DataFrame:
    """Mean and population std over folds of accuracy, precision, recall, F1, ROC AUC."""
    per_fold = with_basic_metrics(confusion(fold_scores, threshold, [fold_col], label, score))
    per_fold = per_fold.join(areas(fold_scores, [fold_col], label, score), fold_col)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    long = per_fold.unpivot([fold_col], names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.count(F.lit(1)).alias("n_folds"))
