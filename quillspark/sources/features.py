"""Feature frames: named numeric columns as doubles, with an optional label and row id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expr import column as named

NUMERIC = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def resolve(df: DataFrame, name: str) -> str:
    """The first column called `name`, whatever its case."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise KeyError(f"no column {name!r}")


def numeric(df: DataFrame, name: str, null_policy: str = "error") -> Column:
    """A column as double. Other than numeric types are an error; nulls follow the policy: `error`, `drop` or `keep`."""
    c = resolve(df, name)
    kind = df.schema[c].dataType
    if not isinstance(kind, NUMERIC):
        raise TypeError(f"column {c!r} has type {kind.simpleString()}, which is not numeric")
    value = named(c).cast("double")
    if null_policy == "error":
        value = F.when(value.isNull(), F.raise_error(F.lit(f"null in column {c}"))).otherwise(value)
    return value.alias(name)


def to_features(df: DataFrame, features: Sequence[str], label: str | None = None, id_col: str | None = None, null_policy: str = "error") -> DataFrame:
    """The named columns as doubles under the names asked for, then the label, then the row id as it is.

    A projection: only these columns are read from Parquet. With `drop`, rows with a
    null among them are left out by a filter.
    """
    if df is None:
        raise ValueError("a DataFrame is needed")
    if not features:
        raise ValueError("at least one feature is needed")
    if null_policy not in ("error", "drop", "keep"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    names = [*features, *([label] if label else [])]
    if null_policy == "drop":
        df = df.filter(reduce(and_, [named(resolve(df, c)).isNotNull() & ~F.isnan(named(resolve(df, c)).cast("double")) for c in names]))
    columns = [numeric(df, c, null_policy) for c in names]
    if id_col:
        columns.append(named(resolve(df, id_col)).alias(id_col))
    return df.select(*columns)


#: Tables up to this size are dealt out anew before they are read again and again.
SMALL_ROWS = 4_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which has so many rows, over all cores if it is small: a small table often lies in one file, which one core would read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SMALL_ROWS else df


def read_features(spark: SparkSession, path: str, features: Sequence[str], label: str | None = None, id_col: str | None = None, null_policy: str = "error") -> DataFrame:
    """`to_features` of a Parquet table."""
    return to_features(spark.read.parquet(path), features, label, id_col, null_policy)


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]] | np.ndarray, names: Sequence[str] | None = None, id_col: str = "row_id") -> DataFrame:
    """A small matrix, row by row, with its row numbers."""
    matrix = np.asarray(rows, float)
    if matrix.ndim != 2 or not matrix.size:
        raise ValueError("a matrix with rows and columns is needed")
    names = list(names or (f"f{i}" for i in range(matrix.shape[1])))
    if len(names) != matrix.shape[1]:
        raise ValueError("as many names as columns are needed")
    schema = T.StructType([T.StructField(id_col, T.LongType(), False), *(T.StructField(c, T.DoubleType()) for c in names)])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(matrix)], schema)


def from_columns(spark: SparkSession, columns: dict[str, Sequence[float]], id_col: str = "row_id") -> DataFrame:
    """A small matrix, column by column; columns of different lengths are an error."""
    if len({len(c) for c in columns.values()}) != 1:
        raise ValueError("columns of one length are needed")
    return from_rows(spark, np.array(list(columns.values()), float).T, list(columns), id_col)


def column(df: DataFrame, name: str) -> DataFrame:
    return df.select(numeric(df, name, "keep"))


def row(df: DataFrame, id_col: str, value) -> DataFrame:
    """The row with an id; a filter that reaches the scan."""
    return df.filter(named(id_col) == F.lit(value))


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A new frame in which a column has other values."""
    return df.withColumn(resolve(df, name), value)


def value(df: DataFrame, id_col: str, key, name: str):
    """One cell, None if the row is absent: a filter and a projection that both reach the scan."""
    found = row(df, id_col, key).select(numeric(df, name, "keep")).first()
    return None if found is None else found[0]


def to_matrix(df: DataFrame, names: Sequence[str], id_col: str, max_rows: int = 100_000) -> np.ndarray:
    """Small frames only: rows in the order of the id as a matrix on the driver. More than `max_rows` rows are an error."""
    rows = to_features(df, names, id_col=id_col, null_policy="keep").orderBy(named(id_col)).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return rows[list(names)].to_numpy(float)
