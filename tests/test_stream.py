"""Stream scoring: rejects, restart on the same checkpoint, replay of a batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from calyx.operators.explain import scratch_path
from calyx.plans import studies as ST
from calyx.sources import fixtures as FX
from calyx.streaming.score_stream import run_to_completion, score_stream
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def saved(spark):
    path, model, _ = ST.saved_model(spark, SF_SMALL)
    return path, model


def put(rows, folder, part, of):
    rows.where(F.col("id") % of == part).select("id", *ST.SCORE_COLUMNS).coalesce(1).write.mode("append").parquet(folder)


def test_stopped_after_a_batch_and_restarted(spark, saved):
    rows = FX.loan_with_nulls(spark, SF_SMALL).cache()
    src, ckpt, out, bad = (scratch_path(spark, f"stream-{n}") for n in ("src", "ckpt", "out", "bad"))
    for part in range(3):
        put(rows, src, part, 4)
    schema = spark.read.parquet(src).schema
    query = score_stream(spark, saved[0], src, schema, ST.SCORE_COLUMNS, ckpt, out, bad, available_now=False, files_per_batch=1)
    deadline = time.time() + 120
    while not query.recentProgress and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    done = os.listdir(os.path.join(ckpt, "commits"))
    assert done
    put(rows, src, 3, 4)
    again = score_stream(spark, saved[0], src, schema, ST.SCORE_COLUMNS, ckpt, out, bad, files_per_batch=1)
    scored, rejected = run_to_completion(spark, again, out, bad)
    wanted = ST.complete_rows(rows)
    assert sorted(r[0] for r in scored.select("id").collect()) == sorted(
        r["id"] for r in wanted.where("status = 'complete'").collect())
    assert sorted((r["id"], r["missing_columns"]) for r in rejected.collect()) == sorted(
        (r["id"], r["missing_columns"]) for r in wanted.where("status = 'rejected'").collect())


def test_a_batch_that_runs_again_replaces_its_rows(spark, saved):
    rows = FX.loan_with_nulls(spark, SF_SMALL)
    src, out, bad = (scratch_path(spark, f"stream-{n}") for n in ("src", "out", "bad"))
    put(rows, src, 0, 1)
    schema = spark.read.parquet(src).schema
    for _ in range(2):  # a lost checkpoint: batch 0 runs twice
        query = score_stream(spark, saved[0], src, schema, ST.SCORE_COLUMNS, scratch_path(spark, "stream-ckpt"), out, bad)
        scored, rejected = run_to_completion(spark, query, out, bad)
    assert scored.count() + rejected.count() == rows.count()


def test_missing_column_is_refused(spark, saved):
    schema = FX.loan_with_nulls(spark, SF_SMALL).select("id", "age").schema
    with pytest.raises(ValueError, match="income"):
        score_stream(spark, saved[0], "/none", schema, ST.SCORE_COLUMNS, "/none", "/none", "/none")


def test_scores_equal_the_batch_scorer(spark, saved):
    both = ST.stream_score(spark, SF_SMALL).where("status = 'scored'").select("id", F.col("Probability Personal Loan = 1").alias("p"))
    rows = FX.loan_with_nulls(spark, SF_SMALL).dropna(subset=ST.SCORE_COLUMNS)
    batch = ST.batch_score(spark, SF_SMALL, saved[0], rows).select("id", F.col("Probability Personal Loan = 1").alias("q"))
    joined = both.join(batch, "id").collect()
    assert len(joined) == rows.count() and all(abs(r["p"] - r["q"]) < 1e-9 for r in joined)
