"""Scalar column expressions (B1, B4-B7, B9).  All JVM-side, codegen-friendly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_lower(c: Column | str, lower: float = 0) -> Column:
    """`clip(lower=...)`: NULL stays NULL (unlike `greatest`, which skips NULLs)."""
    c = _c(c)
    return F.when(c < lower, F.lit(lower)).otherwise(c)


def ratio_guarded(num: Column | str, den: Column | str) -> Column:
    """num / den with a zero denominator replaced by 1."""
    den = _c(den)
    return _c(num) / F.when(den == 0, F.lit(1)).otherwise(den)


def ratio_smoothed(num: Column | str, den: Column | str, plus: float = 1.0) -> Column:
    return _c(num) / (_c(den) + F.lit(plus))


def right_closed_bins(c: Column | str, edges: Sequence[float], labels: Sequence[str],
                      missing: str = "nan") -> Column:
    """`(lo, hi]` interval labels; out of range and NULL give the `missing` label
    (the string a categorical NaN becomes once cast to text)."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    c = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(missing))


def apply_threshold(score: Column | str, threshold: float) -> Column:
    """Class 1 when score >= threshold (inclusive, unlike Spark's own `threshold`)."""
    return (_c(score) >= F.lit(float(threshold))).cast("int")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, NumericType) and f.name not in exclude]


def infer_column_kinds(df: DataFrame, exclude: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(column, 'numeric' | 'categorical') in schema order."""
    return [(f.name, "numeric" if isinstance(f.dataType, NumericType) else "categorical")
            for f in df.schema.fields if f.name not in exclude]


# Bin edges and labels of the engineered age and income bands.
AGE_EDGES = [20, 30, 40, 50, 60, 80]
AGE_LABELS = ["20s", "30s", "40s", "50s", "60+"]
INCOME_EDGES = [0, 40, 80, 120, 170, 300]
INCOME_LABELS = ["low", "lower_mid", "upper_mid", "high", "very_high"]


def engineer_features(df: DataFrame) -> DataFrame:
    """Ratios, interactions and right-closed bands of the loan-shaped table."""
    return df.select(
        "*",
        ratio_guarded("income", "family").alias("income_per_family"),
        (F.col("income") * F.col("education")).alias("income_x_education"),
        (F.col("ccavg") * F.col("income")).alias("ccavg_x_income"),
        ratio_smoothed("mortgage", "income").alias("mortgage_to_income"),
        right_closed_bins("age", AGE_EDGES, AGE_LABELS).alias("age_bin"),
        right_closed_bins("income", INCOME_EDGES, INCOME_LABELS).alias("income_bin"),
    )


def missing_names(cols: Sequence[str]) -> Column:
    """Names of those of `cols` that are null in a row, in their order, joined by commas; '' if none is."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
