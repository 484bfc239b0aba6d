"""Grids: folds of a small table side by side, those of a large one in turn, with the same scores."""

import threading

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from calyx.operators import models as M
from calyx.operators import search as G


def folded(spark):
    return spark.range(200).select(
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") * 7 % 11).cast("double").alias("z"),
        (F.col("id") * 31 % 23 > 10).cast("int").alias("label"), (F.col("id") % 4).cast("int").alias("fold")).coalesce(1)


def test_folds_side_by_side_score_as_in_turn(spark, monkeypatch):
    rows, lr = folded(spark).persist(), M.logistic(1.0, "l2", 150.0, max_iter=20)
    maps = [{lr.regParam: r} for r in (0.001, 0.1)]
    working, most, lock, fit = set(), [0], threading.Lock(), VectorAssembler.transform

    def watched(self, df, params=None):
        with lock:
            working.add(threading.get_ident())
            most[0] = max(most[0], len(working))
        return fit(self, df, params)

    monkeypatch.setattr(VectorAssembler, "transform", watched)
    prep = M.FourierKernel(inputCol="xz", gamma="0.1", nComponents=6)
    from pyspark.ml import Pipeline
    lr.setFeaturesCol("rff")
    stages = Pipeline(stages=[VectorAssembler(inputCols=["x", "z"], outputCol="xz"), prep])
    assert G.folds_at_once(rows, 4) == 4 and G.folds_at_once(rows.repartition(40), 4) == 1
    at_once = G.encoded_fold_scores(spark, stages, lr, maps, rows, n_folds=4)
    assert most[0] > 1  # folds prepared by several threads
    monkeypatch.setattr(G, "FOLD_PARTITIONS", 0)
    in_turn = G.encoded_fold_scores(spark, stages, lr, maps, rows, n_folds=4)
    assert at_once == in_turn and len(at_once) == 2 and all(len(s) == 4 for s in at_once)
    rows.unpersist()
