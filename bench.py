"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries run over `line_base` (every lineitem row) and the loan study table.
Each result is materialised with the `noop` sink, so the full plan runs
without pulling rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from calyx.operators import collinearity as C  # noqa: E402
from calyx.operators import evaluate as E  # noqa: E402
from calyx.operators import models as M  # noqa: E402
from calyx.operators import profile as P  # noqa: E402
from calyx.operators import sampling as S  # noqa: E402
from calyx.plans.studies import flagship  # noqa: E402
from calyx.session import get_spark  # noqa: E402
from calyx.sources import fixtures as FX  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", "calyx-bench", **{"spark.sql.shuffle.partitions": str(cpus)})
    line = lambda: FX.line_base(spark, sf_dir)
    scored = lambda: line().select(F.col("l_orderkey").alias("id"), "label", F.col("p").alias("score"))

    def q_lr():
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler

        from calyx.operators.encode import PopulationScaler
        df = S.stratified_split(line().withColumn("id", F.xxhash64(*FX.LINE_KEY)))
        df = df.select("id", "label", *FX.LINE_FEATURES, "split").persist()  # reused by every fit pass
        train, test = df.where("split = 'train'"), df.where("split = 'test'")
        pipe = Pipeline(stages=[PopulationScaler(inputCols=FX.LINE_FEATURES),
                                VectorAssembler(inputCols=FX.LINE_FEATURES, outputCol="features"),
                                M.logistic(1.0, "l2", 480_000, max_iter=100)])
        model = pipe.fit(train)
        out = M.positive_probability(model.transform(test)).select("label", "score")
        return E.metrics_table(out)

    queries = {
        "describe": lambda: P.describe_table(line(), FX.LINE_FEATURES),
        "class_weights": lambda: P.class_weights(line()),
        "corr_matrix": lambda: C.corr_matrix(line(), FX.LINE_FEATURES),
        "stratified_split": lambda: S.stratified_split(line().withColumn("id", F.xxhash64(*FX.LINE_KEY)))
                                      .groupBy("split", "label").count(),
        "kfold": lambda: S.kfold(line().withColumn("id", F.xxhash64(*FX.LINE_KEY)), shuffle=True)
                          .groupBy("fold", "label").count(),
        "metrics_table": lambda: E.metrics_table(scored()),
        "roc_curve": lambda: E.roc_curve(scored()),
        "threshold_sweep": lambda: E.threshold_sweep(scored()),
        "calibration_curve": lambda: E.calibration_curve(scored()),
        "boxplot_stats": lambda: P.boxplot_stats(line(), ["l_quantity", "l_discount"]),
        "lr_fit_score": q_lr,
        "flagship": lambda: flagship(spark, sf_dir),
    }
    run(spark.range(10))  # warm-up
    times = {}
    for name, q in queries.items():
        t0 = time.time()
        run(q())
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
