"""Accuracy, mean squared error and R2, each one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.features import numeric


def accuracy_frame(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of rows whose half-even rounded values agree; NaN agrees with nothing; no rows give 0."""
    a, p = numeric(df, actual), numeric(df, predicted)
    same = (F.rint(a) == F.rint(p)) & ~F.isnan(a) & ~F.isnan(p)
    return df.agg(F.coalesce(F.avg(F.when(same, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def mse_frame(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean squared difference; no rows give 0."""
    d = numeric(df, actual) - numeric(df, predicted)
    return df.agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("mse"))


def r2_frame(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """1 - residual / total sum of squares; 1 if the actual values do not vary; null without rows."""
    a, p = numeric(df, actual), numeric(df, predicted)
    rest, whole = F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a)
    return df.agg(F.when(whole == 0, 1.0).otherwise(1.0 - rest / F.when(whole != 0, whole)).alias("r2"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> float:
    return accuracy_frame(df, actual, predicted).first()[0]


def mean_squared_error(df: DataFrame, actual: str, predicted: str) -> float:
    return mse_frame(df, actual, predicted).first()[0]


def r2_score(df: DataFrame, actual: str, predicted: str) -> float:
    value = r2_frame(df, actual, predicted).first()[0]
    if value is None:
        raise ValueError("R2 needs rows")
    return value
