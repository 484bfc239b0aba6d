"""CSV files with a declared schema, and kernel features."""

import uuid

import pytest
from pyspark.sql import functions as F

from calyx.operators.models import FourierKernel
from calyx.session import ensure_checkpoint_dir
from calyx.sources.tables import good_lines, load_table


def test_csv_keeps_lines_that_do_not_fit(spark):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    lines = ["c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment", '1,"a, b",3,4.5,X', "two,b,3,4.5,X", "3,,,,", "4,d,3", ""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    good, bad = good_lines(load_table(spark, "", "customer", "csv", path=path).cache())
    assert sorted(map(tuple, good.collect())) == [(1, "a, b", 3, 4.5, "X"), (3, None, None, None, None)]
    assert sorted(r[0] for r in bad.collect()) == ["4,d,3", "two,b,3,4.5,X"]


@pytest.mark.parametrize("rule,gamma", [("scale", 1 / (2 * 1.25)), ("auto", 0.5), ("0.01", 0.01)])
def test_kernel_gamma(spark, rule, gamma):
    from pyspark.ml.functions import array_to_vector
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "a array<double>").select(array_to_vector(F.col("a")).alias("features"))
    model = FourierKernel(gamma=rule, nComponents=3).fit(rows)
    assert model.getOrDefault(model.gamma) == pytest.approx(gamma)
    assert model.transform(rows).first()["rff"].size == 3
