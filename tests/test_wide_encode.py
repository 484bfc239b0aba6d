"""One-hot vectors of wide columns: any number of categories, dictionary as a table."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from calyx.operators import encode as EN
from calyx.operators.explain import scratch_path
from calyx.operators.wide_encode import WideOneHot

N = 5000


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(3 * N).select("id", F.format_string("c%05d", F.col("id") % N).alias("s"), (F.col("id") % 7).cast("double").alias("x"),
                                     (F.col("id") % 2).cast("int").alias("label")).cache()


def slots(df, vector):
    a = vector_to_array(F.col(vector))
    at = F.array_position(a, 1.0)
    return df.select("s", F.size(a).alias("size"), (at - 1).alias("slot"), F.aggregate(a, F.lit(0.0), lambda x, y: x + y).alias("total"))


@pytest.mark.parametrize("drop_first", [True, False])
def test_every_category_has_its_slot(wide, drop_first):
    model = WideOneHot(inputCol="s", outputCol="v", dropFirst=drop_first).fit(wide)
    rows = slots(model.transform(wide), "v").collect()
    assert len(rows) == 3 * N
    for r in rows:
        want = int(r["s"][1:]) - int(drop_first)
        assert r["size"] == N - int(drop_first)
        assert (r["slot"], r["total"]) == ((want, 1.0) if want >= 0 else (-1, 0.0))
    names = {r["slot"]: r["name"] for r in model.featureNames().collect()}
    assert len(names) == N - int(drop_first) and names[0] == ("s__c00001" if drop_first else "s__c00000")


def test_unseen_null_repeats_and_reload(spark, wide):
    model = WideOneHot(inputCol="s", outputCol="v").fit(wide)
    path = scratch_path(spark, "wide-model")
    PipelineModel([model]).write().overwrite().save(path)
    again = PipelineModel.load(path)
    rows = spark.createDataFrame([("c00007", 1), ("c00007", 1), ("none", 2), (None, 3), ("c00000", 4)], "s string, position int")
    for m in (model, again):
        out = m.transform(rows)
        assert out.columns == ["s", "position", "v"]
        got = sorted((r["s"] or "", r["slot"], r["total"]) for r in slots(out, "v").collect())
        assert got == [("", -1, 0.0), ("c00000", -1, 0.0), ("c00007", 6, 1.0), ("c00007", 6, 1.0), ("none", -1, 0.0)]


def test_empty_table(spark):
    rows = spark.createDataFrame([("a",), (None,)], "s string")
    model = WideOneHot(inputCol="s", outputCol="v").fit(rows.where("s = 'z'"))
    assert [r["size"] for r in slots(model.transform(rows), "v").collect()] == [0, 0]


def test_preprocessor_takes_wide_columns(wide):
    model = EN.preprocessor(None, ["x"], ["s"]).fit(wide)
    out = model.transform(wide).select("s", "x", "features")
    assert out.select(F.size(vector_to_array("features")).alias("n")).distinct().collect()[0]["n"] == 1 + N - 1
    row = out.where("s = 'c00003'").first()
    assert list(row["features"].toArray().nonzero()[0])[-1] == 3


def test_narrow_columns_keep_their_indicators(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "s string, x double")
    model = EN.preprocessor(None, ["x"], ["s"]).fit(rows)
    assert EN.feature_names(model.transform(rows)) == ["x", "s__b", "s__c"]


def test_pipeline_with_a_classifier(wide):
    from calyx.operators import models as M
    fit = Pipeline(stages=[*EN.preprocessor(None, ["x"], ["s"]).getStages(), M.logistic(1.0, "l2", 3 * N, max_iter=3)]).fit(wide)
    assert len(fit.stages[-1].coefficients) == N
