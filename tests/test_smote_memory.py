"""What a worker holds to compare visitors with a block."""

import numpy as np

from calyx.operators import smote as SM


def test_slices_of_visitors_find_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(150, 3)), 1)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.unique(x, axis=0))], "rep long, a double, b double, c double")

    def found() -> set:
        return {tuple(r) for r in SM.nearest_neighbours(points, ["a", "b", "c"], 4).collect()}

    whole = found()
    monkeypatch.setattr(SM, "SLICE", 7)
    assert found() == whole and len(whole) == 4 * points.count()


def test_no_more_distances_at_once_than_a_slice_has():
    assert SM.SLICE * SM.BLOCK * 8 <= 1 << 22  # 4 MB a matrix, of which ordering takes a few
