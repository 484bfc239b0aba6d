"""Feature transforms fitted on train, applied anywhere.

They are `pyspark.ml` Estimators/Models, so they sit in a `Pipeline`, fit
once per CV fold, and persist with `PipelineModel.save`.  Fitting is one
aggregation pass; the fitted statistics are a few numbers per column.  The
transform is a plain column expression (codegen, no Python at run time).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from calyx.operators.ranking import exact_quantiles
from calyx.operators.wide_encode import WideOneHot

# A drop-first encoder makes one column per category; a column with more
# categories than this becomes one sparse vector instead.
MAX_DENSE_CATEGORIES = 1000


class _Cols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to transform", TypeConverters.toListString)
    stats = Param(Params._dummy(), "stats", "fitted statistics, one per column", TypeConverters.toList)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class _FittedColumnModel(Model, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols=None, stats=None):
        super().__init__()
        self._set(inputCols=inputCols or [], stats=stats or [])

    def getStats(self) -> list:
        return self.getOrDefault(self.stats)


# ---- E1 / E2 imputers -------------------------------------------------------
class MedianImputerModel(_FittedColumnModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) if m is not None else F.col(c)
                               for c, m in zip(self.getInputCols(), self.getStats())})


class MedianImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact median (midpoint of the two middle values) of the train rows."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(inputCols=inputCols or [])

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                             for c in cols])).alias("s")).select("s.*")
        med = {r["column"]: r["q50"] for r in exact_quantiles(long, "value", [0.5], ["column"]).collect()}
        return MedianImputerModel(inputCols=cols, stats=[med.get(c) for c in cols])


class ModeImputerModel(_FittedColumnModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast(df.schema[c].dataType))
                               for c, m in zip(self.getInputCols(), self.getStats())})


class ModeImputer(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent value; among equally frequent values the smallest."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(inputCols=inputCols or [])

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        stats = []
        for c in self.getInputCols():
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            top = counts.agg(F.max("n").alias("m"))
            row = counts.join(top, F.col("n") == F.col("m")).agg(F.min(c).alias("v")).first()
            stats.append(row["v"])
        return ModeImputerModel(inputCols=self.getInputCols(), stats=stats)


# ---- E3 scaler ---------------------------------------------------------------
class PopulationScalerModel(_FittedColumnModel):
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of output columns ('' = in place)",
                         TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        suffix = self.getOrDefault(self.outputSuffix) if self.isDefined(self.outputSuffix) else ""
        return df.withColumns({c + suffix: (F.col(c) - F.lit(mean)) / F.lit(std)
                               for c, (mean, std) in zip(self.getInputCols(), self.getStats())})


class PopulationScaler(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / std with the population std (ddof 0); a zero std divides by 1."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(inputCols=inputCols or [])

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        stats = []
        for i in range(len(cols)):
            s = row[f"s{i}"]
            stats.append([row[f"m{i}"], 1.0 if not s else s])
        return PopulationScalerModel(inputCols=cols, stats=stats)


# ---- E4 drop-first one-hot -----------------------------------------------------
def indicator_name(col: str, category) -> str:
    return f"{col}__{category}"


def wide_name(col: str) -> str:
    return f"{col}__wide"


class DropFirstOneHotModel(_FittedColumnModel):
    """One 0/1 column per category except the first (sorted) one; unseen and
    NULL values give all zeros."""

    def outputCols(self) -> list[str]:
        return [indicator_name(c, v) for c, cats in zip(self.getInputCols(), self.getStats()) for v in cats[1:]]

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, cats in zip(self.getInputCols(), self.getStats()):
            for v in cats[1:]:
                new[indicator_name(c, v)] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
        return df.withColumns(new)


class DropFirstOneHot(Estimator, _Cols, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a `DropFirstOneHotModel`; columns of more than MAX_DENSE_CATEGORIES
    categories get a `WideOneHotModel` each, whose vector is named `<column>__wide`."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(inputCols=inputCols or [])

    def _fit(self, df: DataFrame) -> Model:
        narrow, stats, wide = [], [], []
        for c in self.getInputCols():
            found = df.where(F.col(c).isNotNull()).select(c).distinct()
            cats = [r[0] for r in found.limit(MAX_DENSE_CATEGORIES + 1).collect()]
            if len(cats) > MAX_DENSE_CATEGORIES:
                wide.append(WideOneHot(inputCol=c, outputCol=wide_name(c), dropFirst=True).fit(df))
            else:
                narrow.append(c)
                stats.append(sorted(cats))  # numeric columns sort numerically, strings lexically
        model = DropFirstOneHotModel(inputCols=narrow, stats=stats)
        return PipelineModel([model, *wide]) if wide else model


# ---- E5 full one-hot (sparse, any cardinality) --------------------------------------
def onehot_full_stages(cols: Sequence[str]) -> list:
    """StringIndexer (alphabetical, unseen kept as an extra last index, which its
    metadata lists) + OneHotEncoder dropping that last slot: full one-hot of the
    train categories, unseen -> all zeros, sparse vectors of any width."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__ohe" for c in cols],
                        dropLast=True, handleInvalid="error")
    return [*idx, ohe]


# ---- E6 assembly ---------------------------------------------------------------
def preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                 wide_categorical: Sequence[str] = (), scale: bool = True, impute: bool = False,
                 features_col: str = "features") -> Pipeline:
    """Column transformer as a Pipeline: numeric -> [median impute] -> population
    scale; categorical -> drop-first one-hot; wide categorical -> sparse one-hot;
    everything else dropped by the assembler."""
    stages = []
    if impute:
        stages.append(MedianImputer(inputCols=list(numeric)))
        if categorical:
            stages.append(ModeImputer(inputCols=list(categorical)))
    if scale and numeric:
        stages.append(PopulationScaler(inputCols=list(numeric)))
    asm_inputs = list(numeric)
    if categorical:
        stages.append(_DeferredOneHot(inputCols=list(categorical)))
    if wide_categorical:
        stages += onehot_full_stages(wide_categorical)
        asm_inputs += [f"{c}__ohe" for c in wide_categorical]
    stages.append(_DeferredAssembler(inputCols=asm_inputs, categorical=list(categorical), outputCol=features_col))
    return Pipeline(stages=stages)


class _DeferredOneHot(DropFirstOneHot):
    """Drop-first one-hot whose output names are known only after fitting."""


class _DeferredAssemblerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "assembled columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCol="features"):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        asm = VectorAssembler(inputCols=self.getOrDefault(self.inputCols),
                              outputCol=self.getOrDefault(self.outputCol), handleInvalid="keep")
        return asm.transform(df)

    def featureNames(self) -> list[str]:
        return list(self.getOrDefault(self.inputCols))


class _DeferredAssembler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "numeric / vector inputs", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "drop-first encoded columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, categorical=None, outputCol="features"):
        super().__init__()
        self._set(inputCols=inputCols or [], categorical=categorical or [], outputCol=outputCol)

    def _fit(self, df: DataFrame) -> _DeferredAssemblerModel:
        cats = set(self.getOrDefault(self.categorical))
        ind = [c for c in df.columns if c.startswith(tuple(f"{k}__" for k in cats)) and not c.endswith(("__idx", "__ohe"))]
        return _DeferredAssemblerModel(inputCols=self.getOrDefault(self.inputCols) + ind,
                                       outputCol=self.getOrDefault(self.outputCol))


def feature_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled slots, from the vector column's ML attribute metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs += group
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]


def numeric_and_categorical(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType) and f.name not in exclude]
    return num, cat
