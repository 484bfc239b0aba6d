"""Isotonic regression by ranges: equal to the max-min formula, whatever the number of ranges."""

import random

import pytest

from calyx.operators.isotonic import isotonic_blocks, isotonic_fitted
from calyx.operators.models import isotonic_model


def brute(rows):
    """max over j <= i of min over k >= i of mean(y[j..k]), over distinct x."""
    sums = {}
    for x, y in rows:
        s, n = sums.get(x, (0, 0))
        sums[x] = s + y, n + 1
    xs = sorted(sums)

    def mean(j, k):
        part = [sums[x] for x in xs[j:k + 1]]
        return sum(s for s, _ in part) / sum(n for _, n in part)

    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


def noisy(n, seed):
    r = random.Random(seed)
    return [(round(x, 2), int(r.random() < x)) for x in (r.random() for _ in range(n))]


CASES = {
    "noise": noisy(150, 1),
    "in order": [(float(i), int(i >= 30)) for i in range(60)],
    "reversed": [(float(i), int(i < 30)) for i in range(60)],
    "rising, then one low": [(float(i), i) for i in range(60)] + [(60.0, 0)],
    "one high, then rising": [(-1.0, 45)] + [(float(i), i) for i in range(60)],
    "ties": [(0.5, 1)] * 40 + [(0.5, 0)] * 20 + [(0.7, 0)] * 10 + [(0.1, 1)],
    "one row": [(0.3, 1)],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("rows_per_range", [3, None])
def test_equals_max_min(spark, name, rows_per_range):
    df = spark.createDataFrame(CASES[name], "score double, label int")
    got = {r["score"]: r["fitted"] for r in isotonic_fitted(df, rows_per_range=rows_per_range).collect()}
    want = brute(CASES[name])
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_many_rounds_and_groups(spark):
    cases = {"a": noisy(400, 2), "b": noisy(300, 3), "c": [(0.5, 1)]}
    rows = [(g, x, y) for g, part in cases.items() for x, y in part]
    rows += [(None, 0.1, 1), ("a", None, 1), ("a", 0.2, None), ("a", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {(r["g"], r["score"]): r["fitted"] for r in isotonic_fitted(df, group_cols=["g"], rows_per_range=2).collect()}
    want = {(g, x): v for g, part in cases.items() for x, v in brute(part).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_rise_and_hold_all_rows(spark):
    df = spark.createDataFrame(CASES["noise"], "score double, label int")
    blocks = sorted(isotonic_blocks(df, rows_per_range=4).collect(), key=lambda b: b["lo"])
    assert all(a["hi"] < b["lo"] and a["fitted"] < b["fitted"] for a, b in zip(blocks, blocks[1:]))
    assert sum(b["weight"] for b in blocks) == len(CASES["noise"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "score double, label int")
    assert isotonic_fitted(df).count() == 0 and isotonic_blocks(df).count() == 0


def test_model_has_the_steps(spark):
    df = spark.createDataFrame(CASES["noise"], "score double, label int")
    model = isotonic_model(df)
    want = brute(CASES["noise"])
    scored = model.transform(df.select("score").distinct()).collect()
    assert all(abs(r["fitted"] - want[r["score"]]) < 1e-9 for r in scored)
