"""Nearest neighbours over median-split leaves, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calyx.operators import smote as SM
from calyx.sources import fixtures as FX
from conftest import SF_MID


def brute(ids, x, k):
    d = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        diff = x[:, c][:, None] - x[:, c][None, :]
        d += diff * diff
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, row in enumerate(d):
        order = np.lexsort((ids, row))[:k]
        out[int(ids[i])] = [(int(ids[j]), row[j]) for j in order]
    return out


def run(spark, ids, x, k, **more):
    cols = [f"c{i}" for i in range(x.shape[1])]
    frame = spark.createDataFrame([(int(i), *map(float, row)) for i, row in zip(ids, x, strict=True)], "rep long, " + ", ".join(f"{c} double" for c in cols))
    got = {}
    for r in SM.nearest_neighbours(frame, cols, k, **more).orderBy("rep", "nn_rank").collect():
        got.setdefault(r.rep, []).append((r.nn_id, r.dist2))
    return got


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 40), ("CHUNK", 64), ("SAMPLE", 1024)):
        monkeypatch.setattr(SM, name, value)


@pytest.mark.parametrize("case", ["normal", "grid", "line", "clusters"])
def test_neighbours_are_exact(spark, small_blocks, case):
    rng = np.random.default_rng(8)
    n = 700
    x = {"normal": lambda: rng.normal(size=(n, 3)),
         "grid": lambda: np.stack(np.meshgrid(range(27), range(26)), -1).reshape(-1, 2)[:n].astype(float),  # many ties
         "line": lambda: np.stack([np.arange(n) // 300, np.r_[np.zeros(400), rng.normal(size=300)], np.arange(n) * 1e-6], axis=1),  # one side equal
         "clusters": lambda: rng.normal(size=(n, 4)) * 0.01 + rng.integers(0, 5, n)[:, None]}[case]()
    ids = rng.permutation(n * 3)[:n]
    want, got = brute(ids, x, 5), run(spark, ids, x, 5)
    assert got == {i: [(j, pytest.approx(d)) for j, d in w] for i, w in want.items()}


def test_fewer_points_than_neighbours(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 3.0]])
    assert run(spark, np.array([5, 2, 9]), x, 10) == brute(np.array([5, 2, 9]), x, 2)
    assert run(spark, np.array([5]), x[:1], 3) == {}


def test_far_fewer_than_all_pairs_are_compared(spark, monkeypatch):
    """Eleven dimensions, as in the studies, of which a few are continuous."""
    monkeypatch.setattr(SM, "BLOCK", 64)
    rng = np.random.default_rng(2)
    n = 4000
    x = np.column_stack([rng.integers(20, 60, n), rng.integers(0, 40, n), rng.gamma(2, 30, n).round(1), rng.integers(1, 5, n), rng.gamma(1, 2, n).round(1),
                         rng.integers(1, 4, n), rng.choice([0, 0, 0, 100, 200], n), *rng.integers(0, 2, (4, n))]).astype(float)
    x = np.unique(x, axis=0)
    report = {}
    got = run(spark, np.arange(len(x)), x, 5, report=report)
    each = report["compared"] / report["points"]
    print(f"compared {each:.0f} of {report['points'] - 1} points for each point")
    assert each < 0.25 * report["points"]
    want = brute(np.arange(len(x)), x, 5)
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in range(0, len(x), 7))


def test_embeddings_exact_and_with_a_visit_limit(spark, monkeypatch):
    monkeypatch.setattr(SM, "BLOCK", 64)
    rows = FX.vec_base(spark, SF_MID).select("id", F.col("embedding").cast("array<double>").alias("e")).collect()
    x = np.array([r.e for r in rows])
    ids = np.array([r.id for r in rows])
    _, first = np.unique(x, axis=0, return_index=True)
    x, ids = x[first], ids[first]
    want = brute(ids, x, 5)
    leaves = -(-len(x) // 64)
    for limit in (None, leaves // 2, leaves * 3 // 4):
        report = {}
        got = run(spark, ids, x, 5, visit_limit=limit, report=report)
        recall = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / len(want[i]) for i in want])
        print(f"visit limit {limit}: recall {recall:.3f}, compared {report['compared'] / len(x):.0f} of {len(x) - 1}")
        assert recall == 1 or limit is not None
    assert recall >= 0.9
