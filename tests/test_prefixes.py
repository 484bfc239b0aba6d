"""Trees cut at a depth and forests cut at a number of trees, against separate fits."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from calyx.operators import models as M
from calyx.operators import prefixes as PX
from calyx.plans import studies as ST
from conftest import SF_MID, SF_SMALL

DEPTHS = (1, 2, 4, 5, 6, 7, 8, None)


@pytest.fixture(scope="module")
def rows(spark):
    prep = ST.prepare_loan(spark, SF_MID, weights=True)
    asm = ST.raw_assembler()
    return asm.transform(prep.train).persist(), asm.transform(prep.test).persist()


@pytest.mark.parametrize(("criterion", "leaf", "weight"), [("gini", 1, None), ("entropy", 5, "weight")])
def test_tree_prefixes_equal_separate_fits(rows, criterion, leaf, weight):
    train, test = rows
    deep = M.decision_tree(criterion, None, leaf, weight_col=weight).fit(train)
    got = {(r.id, r.max_depth): r.score for r in PX.depth_scores(deep, train, test, DEPTHS, weight=weight).collect()}
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    cells = {(c["max_depth"], c["part"]): c for c in PX.depth_confusions(deep, both, DEPTHS, weight=weight)}
    for depth in DEPTHS:
        alone = M.decision_tree(criterion, depth, leaf, weight_col=weight).fit(train)
        out = alone.transform(test).select("id", "label", "prediction", vector_to_array("probability")[1].alias("p")).collect()
        for r in out:
            assert got[r.id, depth] == pytest.approx(r.p, abs=1e-9)
        c = cells[depth, "test"]
        assert c["tp"] == sum(r.prediction == 1 and r.label == 1 for r in out) and c["fp"] == sum(r.prediction == 1 and r.label == 0 for r in out)
        assert sum(v for k, v in c.items() if k in ("tp", "fp", "fn", "tn")) == len(out)


def test_forest_prefixes_equal_the_trees_alone(rows):
    train, test = rows
    forest = M.random_forest(12, 5, "sqrt", 2).fit(train)
    sizes = [1, 5, 12]
    got = {r.id: r.scores for r in PX.forest_scores(forest, test, [(t, None) for t in sizes], ["id"]).collect()}
    whole = {r.id: r.p for r in forest.transform(test).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    alone = [{r.id: r.p for r in t.transform(test).select("id", vector_to_array("probability")[1].alias("p")).collect()} for t in forest.trees[:5]]
    assert isinstance(forest, RandomForestClassificationModel) and len(got) == len(whole)
    for i, scores in got.items():
        assert scores[2] == pytest.approx(whole[i], abs=1e-9)
        assert scores[0] == pytest.approx(alone[0][i], abs=1e-9)
        assert scores[1] == pytest.approx(np.mean([t[i] for t in alone]), abs=1e-9)


def test_cut_forest_is_no_deeper(rows):
    train, test = rows
    forest = M.random_forest(8, 6, "sqrt", 2).fit(train)
    for tree, sums in PX.forest_trees(forest, train.sparkSession):
        classes = sums.argmax(axis=1)
        for depth in (0, 1, 3):
            assert len(set(tree.cut(depth, classes).tolist())) <= 2 ** depth
        assert tree.cut(None, classes).tolist() == tree.leaves.tolist()


def test_grids_are_whole(spark, monkeypatch):
    out = ST.grid_search_dt(spark, SF_SMALL).toPandas()
    assert len(out) == 2 * 6 * 4 * 2 and out.is_best.sum() == 1 and out.params.nunique() == len(out)
    best = out[out.is_best].iloc[0]
    assert best.mean_score == out.mean_score.max() and best.candidate == out[out.mean_score == out.mean_score.max()].candidate.min()
    few = ST.grid_search_rf(spark, SF_SMALL, n_trees=10).toPandas()
    assert len(few) == 2 * 2 * 2 and few.mean_score.between(0, 1).all()


def test_depth_sweep_has_every_depth(spark):
    out = ST.dt_depth_sweep(spark, SF_SMALL).toPandas()
    assert sorted(out.max_depth.unique()) == list(range(1, 16)) and len(out) == 30
    train = out[out.split == "train"].sort_values("max_depth").accuracy
    assert train.is_monotonic_increasing and train.iloc[-1] > train.iloc[0]
