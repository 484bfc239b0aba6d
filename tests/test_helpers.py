"""Distributed helpers against numpy / brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calyx.operators import ranking as R
from calyx.operators.smote import nearest_neighbours


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.integers(0, 50, 3000), np.full(2000, 7)]).astype(float)  # a hot value
    grp = np.where(np.arange(len(vals)) % 3 == 0, "a", "b")
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)], "g string, v double")
    out = {r.g: r for r in R.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], n_buckets=16).collect()}
    for g in ("a", "b"):
        want = np.percentile(vals[grp == g], [25, 50, 90])
        got = [out[g].q25, out[g].q50, out[g].q90]
        assert got == pytest.approx(list(want))


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, w)], "s double, w long")
    got = {r.s: r.cum_w for r in R.running_sums(df, [], "s", ["w"], descending=True, n_buckets=8).collect()}
    order = np.argsort(-x)
    cum = np.cumsum(w[order])
    for i, idx in enumerate(order):
        assert got[x[idx]] == cum[i]


def test_rank_in_groups_is_row_number(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id"),
                                  (F.rand(3)).alias("u"))
    r = R.rank_in_groups(df, ["g"], ["u", "id"], R.uniform_bucket("u", 10)).toPandas()
    for g, part in r.groupby("g"):
        part = part.sort_values(["u", "id"])
        assert list(part["rank"]) == list(range(1, len(part) + 1))


def test_nearest_neighbours_exact(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(5, 0.01, (60, 3))])  # dense cluster
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "rep long, a double, b double, c double")
    got = nearest_neighbours(df, ["a", "b", "c"], 4, "rep").toPandas()
    d = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        want = sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:4]
        have = list(got[got.rep == i].sort_values("nn_rank").nn_id)
        assert have == want
