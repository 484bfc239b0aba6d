"""One-hot encoding of columns with any number of categories.

The categories are a dictionary table (category, position) in the shared folder,
positions by a bucketed rank; rows get theirs by a join, and Spark's own encoder
turns the position into a sparse vector.  So no list of categories reaches the
driver or an expression.  A saved model takes its dictionary along.

Null and unseen categories give all zeros; with `dropFirst` the first category
(numbers sort numerically, text lexically) does too.
"""

from __future__ import annotations

import os
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLWritable)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.operators.ranking import rank_by_value
from calyx.session import ensure_checkpoint_dir


class _WideParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "categorical column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "sparse vector column", TypeConverters.toString)
    dropFirst = Param(Params._dummy(), "dropFirst", "whether the first category has no slot", TypeConverters.toBoolean)


class _DictionaryWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.categories().write.parquet(os.path.join(path, "dictionary"))


class _DictionaryReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._set(dictionary=os.path.join(path, "dictionary"))
        return model


class WideOneHotModel(Model, _WideParams, MLReadable, MLWritable):
    dictionary = Param(Params._dummy(), "dictionary", "folder of the table (category, position)", TypeConverters.toString)
    slots = Param(Params._dummy(), "slots", "length of the vector", TypeConverters.toInt)

    def __init__(self, inputCol="", outputCol="", dropFirst=True, dictionary="", slots=0):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, dropFirst=dropFirst, dictionary=dictionary, slots=slots)

    def write(self):
        return _DictionaryWriter(self)

    @classmethod
    def read(cls):
        return _DictionaryReader(cls)

    def categories(self) -> DataFrame:
        """(category, position): positions from 0 in the categories' order."""
        return SparkSession.active().read.parquet(self.getOrDefault(self.dictionary))

    def featureNames(self) -> DataFrame:
        """(slot, name), one row a slot: a table, as there may be many."""
        first = int(self.getOrDefault(self.dropFirst))
        name = F.concat(F.lit(f"{self.getOrDefault(self.inputCol)}__"), F.col("category").cast("string"))
        return self.categories().where(F.col("position") >= first).select((F.col("position") - first).alias("slot"), name.alias("name"))

    def _transform(self, df: DataFrame) -> DataFrame:
        source, out, slots = (self.getOrDefault(p) for p in (self.inputCol, self.outputCol, self.slots))
        first = int(self.getOrDefault(self.dropFirst))
        if not slots:  # no category, or only the first: Spark's encoder takes no fewer than one slot
            return df.withColumn(out, array_to_vector(F.array().cast("array<double>")).alias(out, metadata={"ml_attr": {"num_attrs": 0}}))
        mark = uuid.uuid4().hex[:8]
        key, at, index = f"_category_{mark}", f"_position_{mark}", f"_index_{mark}"
        codes = self.categories().select(F.col("category").alias(key), (F.col("position") - first).alias(at))
        joined = df.join(codes, F.col(source) == F.col(key), "left")
        # the slot after the last is the one that the encoder drops
        place = F.when(F.col(at) >= 0, F.col(at)).otherwise(F.lit(slots)).cast("double")
        rows = joined.withColumn(index, place.alias(index, metadata={"ml_attr": {"type": "nominal", "num_vals": slots + 1}}))
        encoder = OneHotEncoder(inputCol=index, outputCol=out, dropLast=True, handleInvalid="error")
        return encoder.fit(rows).transform(rows).drop(key, at, index)


class WideOneHot(Estimator, _WideParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol="", outputCol="", dropFirst=True):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, dropFirst=dropFirst)

    def _fit(self, df: DataFrame) -> WideOneHotModel:
        source, first = self.getOrDefault(self.inputCol), self.getOrDefault(self.dropFirst)
        found = df.select(F.col(source).alias("category")).where("category is not null").distinct()
        path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "calyx", f"categories-{uuid.uuid4().hex[:12]}")
        ranked = rank_by_value(found, [], "category", rank_col="rank")
        ranked.select("category", (F.col("rank") - 1).cast("long").alias("position")).write.parquet(path)
        size = df.sparkSession.read.parquet(path).count()
        return WideOneHotModel(inputCol=source, outputCol=self.getOrDefault(self.outputCol), dropFirst=first,
                               dictionary=path, slots=max(size - int(first), 0))
