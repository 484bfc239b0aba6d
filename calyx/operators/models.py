"""Model families with the reference's parameter meanings mapped onto Spark ML (F*).

* C (inverse regularisation on the summed loss) -> regParam = 1 / (C * sum of weights),
  since Spark regularises the mean loss; standardization off (the pipeline scales).
* class_weight='balanced' -> a weight column n / (k * n_c).
* max_depth=None -> 30 (Spark's limit); min_samples_leaf -> minInstancesPerNode.
* every estimator gets seed 42 (PySpark's default seed changes per process).
* probabilities are always read from `probability[1]`; class 1 when p >= t.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calyx.operators.isotonic import isotonic_blocks

SEED = 42


def logistic(C: float = 1.0, penalty: str = "l2", n_weight: float = 1.0, max_iter: int = 300,
             weight_col: str | None = None, features: str = "features", label: str = "label") -> LogisticRegression:
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * n_weight),
                            elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
                            maxIter=max_iter, tol=1e-5)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def decision_tree(criterion: str = "gini", max_depth: int | None = 5, min_samples_leaf: int = 1,
                  weight_col: str | None = None, features: str = "features", label: str = "label",
                  max_bins: int = 128) -> DecisionTreeClassifier:
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity=criterion,
                                maxDepth=30 if max_depth is None else max_depth,
                                minInstancesPerNode=min_samples_leaf, maxBins=max_bins, seed=SEED)
    if weight_col:
        dt.setWeightCol(weight_col)
    return dt


def random_forest(n_estimators: int = 200, max_depth: int | None = None, max_features: str = "sqrt",
                  min_samples_leaf: int = 1, weight_col: str | None = None, features: str = "features",
                  label: str = "label", max_bins: int = 64) -> RandomForestClassifier:
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_estimators,
                                maxDepth=30 if max_depth is None else max_depth,
                                featureSubsetStrategy=max_features, minInstancesPerNode=min_samples_leaf,
                                maxBins=max_bins, bootstrap=True, seed=SEED)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def linear_svc(C: float = 1.0, n_weight: float = 1.0, weight_col: str | None = None, max_iter: int = 100,
               features: str = "features", label: str = "label") -> LinearSVC:
    svc = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (C * n_weight),
                    standardization=False, maxIter=max_iter, tol=1e-5)
    if weight_col:
        svc.setWeightCol(weight_col)
    return svc


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def margin(df: DataFrame, raw_col: str = "rawPrediction", out: str = "margin") -> DataFrame:
    """Decision value of a linear SVC: rawPrediction[1] (= -rawPrediction[0])."""
    return df.withColumn(out, vector_to_array(F.col(raw_col))[1])


# ---- resampling inside fit -------------------------------------------------------
class ResampledClassifier(Estimator, MLReadable, MLWritable):
    """Fit = SMOTE on the training rows, then the wrapped classifier.

    Returns only the classifier's model, so scoring never resamples: inside a
    CrossValidator the resampling touches only each fold's train part.  Both
    parameters can be axes of a grid; saving keeps them and the classifier.
    """

    smoteK = Param(Params._dummy(), "smoteK", "neighbours of SMOTE", TypeConverters.toInt)
    smoteSeed = Param(Params._dummy(), "smoteSeed", "seed of SMOTE", TypeConverters.toInt)

    def __init__(self, classifier=None, smoteK=5, smoteSeed=SEED):
        super().__init__()
        self.classifier = classifier
        self._set(smoteK=smoteK, smoteSeed=smoteSeed)

    def _fit(self, df: DataFrame):
        from calyx.operators.smote import smote_vectors
        c = self.classifier
        return c.fit(smote_vectors(df, c.getFeaturesCol(), c.getLabelCol(), k=self.getOrDefault(self.smoteK),
                                   seed=self.getOrDefault(self.smoteSeed)))

    def copy(self, extra=None):
        that = super().copy(extra)
        that.classifier = self.classifier.copy(extra or {})
        return that

    def write(self):
        return _ResampledWriter(self)

    @classmethod
    def read(cls):
        return _ResampledReader(cls)


class _ResampledWriter(MLWriter):
    def __init__(self, instance: ResampledClassifier):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.classifier.write().save(f"{path}/classifier")


class _ResampledReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ResampledClassifier:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(DefaultParamsReader.loadParamsInstance(f"{path}/classifier", self.sparkSession))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


# ---- kernel approximation (RBF via random Fourier features) ----------------------------
class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma I), b ~ U[0, 2 pi):
    a linear model on z approximates an RBF-kernel machine (Rahimi & Recht 2007).

    W is D x p (small, drawn on the driver with a fixed seed); the product runs
    in Arrow batches inside the executors.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector input", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector output", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "RBF gamma", TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "D", TypeConverters.toInt)
    nFeatures = Param(Params._dummy(), "nFeatures", "p", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", gamma=1.0, nComponents=300, nFeatures=1, seed=SEED):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, nComponents=nComponents,
                  nFeatures=nFeatures, seed=seed)

    def _weights(self):
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        d, p = self.getOrDefault(self.nComponents), self.getOrDefault(self.nFeatures)
        w = rng.normal(0.0, math.sqrt(2.0 * self.getOrDefault(self.gamma)), size=(d, p))
        b = rng.uniform(0.0, 2 * math.pi, size=d)
        return w, b

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = self._weights()
        scale = math.sqrt(2.0 / w.shape[0])

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(xs: pd.Series) -> pd.Series:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, w.shape[1]))
            z = scale * np.cos(x @ w.T + b)
            return pd.Series(list(z))

        arr = vector_to_array(F.col(self.getOrDefault(self.inputCol)))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(arr)))


class FourierKernel(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features whose gamma comes from the rows it is fitted on: a number, or 'scale' (1 / (p Var)) or
    'auto' (1 / p)."""

    inputCol = Param(Params._dummy(), "inputCol", "vector input", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector output", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "'scale', 'auto' or a number", TypeConverters.toString)
    nComponents = Param(Params._dummy(), "nComponents", "D", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", gamma="scale", nComponents=300):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, nComponents=nComponents)

    def _fit(self, df: DataFrame) -> RandomFourierFeatures:
        source, rule = self.getOrDefault(self.inputCol), self.getOrDefault(self.gamma)
        p = len(df.select(vector_to_array(F.col(source)).alias("a")).first()["a"])
        gamma = gamma_scale(df, source, p) if rule == "scale" else 1.0 / p if rule == "auto" else float(rule)
        return RandomFourierFeatures(inputCol=source, outputCol=self.getOrDefault(self.outputCol), gamma=gamma,
                                     nComponents=self.getOrDefault(self.nComponents), nFeatures=p, seed=SEED)


def gamma_scale(df: DataFrame, features: str = "features", n_features: int | None = None) -> float:
    """gamma='scale' = 1 / (p * Var(X)) with Var over all entries of the matrix."""
    arr = df.select(F.explode(vector_to_array(F.col(features))).alias("v"))
    row = arr.agg(F.var_pop("v").alias("var"), F.count(F.lit(1)).alias("n")).first()
    p = n_features or len(df.select(vector_to_array(F.col(features)).alias("a")).first()["a"])
    return 1.0 / (p * row["var"]) if row["var"] else 1.0


# ---- calibration ---------------------------------------------------------------
class PlattCalibratorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    a = Param(Params._dummy(), "a", "slope", TypeConverters.toFloat)
    b = Param(Params._dummy(), "b", "intercept", TypeConverters.toFloat)
    inputCol = Param(Params._dummy(), "inputCol", "margin column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "calibrated probability", TypeConverters.toString)

    def __init__(self, a=0.0, b=0.0, inputCol="margin", outputCol="score"):
        super().__init__()
        self._set(a=a, b=b, inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.getOrDefault(self.a)) * F.col(self.getOrDefault(self.inputCol)) + F.lit(self.getOrDefault(self.b))
        return df.withColumn(self.getOrDefault(self.outputCol), 1.0 / (1.0 + F.exp(-z)))


class PlattCalibrator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Sigmoid fit on margins with the smoothed targets (N+ + 1)/(N+ + 2) and
    1/(N- + 2): each row becomes a weighted positive and a weighted negative,
    fitted by an unregularised 1-feature logistic regression."""

    inputCol = Param(Params._dummy(), "inputCol", "margin column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "calibrated probability", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="margin", outputCol="score"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, df: DataFrame) -> PlattCalibratorModel:
        m = self.getOrDefault(self.inputCol)
        counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        hi = (counts.get(1, 0) + 1.0) / (counts.get(1, 0) + 2.0)
        lo = 1.0 / (counts.get(0, 0) + 2.0)
        t = F.when(F.col("label") == 1, hi).otherwise(lo)
        soft = df.select(F.col(m).alias("_m"), t.alias("_t")).select(
            "_m", F.explode(F.array(F.struct(F.lit(1.0).alias("_y"), F.col("_t").alias("_w")),
                                    F.struct(F.lit(0.0).alias("_y"), (1 - F.col("_t")).alias("_w")))).alias("s"))
        soft = soft.select(array_to_vector(F.array("_m")).alias("_f"), "s._y", "s._w")
        lr = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", regParam=0.0,
                                standardization=False, maxIter=200)
        fit = lr.fit(soft)
        return PlattCalibratorModel(a=float(fit.coefficients[0]), b=float(fit.intercept),
                                    inputCol=m, outputCol=self.getOrDefault(self.outputCol))


def isotonic_model(df: DataFrame, x: str = "score", label: str = "label") -> IsotonicRegressionModel:
    """Isotonic fit of the label on x (linear between steps, clipped outside).

    The steps come from `operators.isotonic`; Spark's model is fitted on the two
    ends of each, so its driver-side merge sees steps and not scores."""
    ends = isotonic_blocks(df, x, label).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(x),
                                                F.col("fitted").alias("_y"), F.col("weight").alias("_w"))
    iso = IsotonicRegression(featuresCol=x, labelCol="_y", weightCol="_w", predictionCol="fitted", isotonic=True)
    return iso.fit(ends)
