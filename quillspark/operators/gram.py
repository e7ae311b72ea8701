"""Sums of products over rows: Gram matrices, moments and covariances.

A few columns become one aggregate of d(d+1)/2 sums in generated code. Wide data,
or one array column, goes through Arrow batches: every batch adds a product of
matrices and a partition hands on d(d+1)/2 numbers. Only d x d numbers reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.vectors import is_vector, matrix, vector
from quillspark.sources.features import numeric

#: Up to so many columns are summed as expressions.
NARROW = 12


def pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def gram_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, value) of X'X, both triangles, for a few columns."""
    sums = df.agg(*(F.sum(numeric(df, names[i]) * numeric(df, names[j])).alias(f"s_{i}_{j}") for i, j in pairs(len(names))))
    return _long(sums, len(names))


def covariance_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, value) of the sample covariance; 0 for a single row."""
    sums = df.agg(*(F.coalesce(F.covar_samp(numeric(df, names[i]), numeric(df, names[j])), F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in pairs(len(names))))
    return _long(sums, len(names))


def _long(sums: DataFrame, d: int) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{min(i, j)}_{max(i, j)}").alias("value")) for i in range(d) for j in range(d)]
    return sums.select(F.explode(F.array(*cells)).alias("cell")).select("cell.i", "cell.j", "cell.value")


def wide_sums(rows: DataFrame, shift: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum x, sum xx') of x less `shift`, over all rows of number and array columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            x = x if shift is None else x - shift
            n += len(x)
            one = x.sum(0) if one is None else one + x.sum(0)
            two = x.T @ x if two is None else two + x.T @ x
        if n:
            d = len(one)
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-2], np.full(d, -1), i]).astype(np.int32)), pa.array(np.concatenate([[0], np.arange(d), j]).astype(np.int32)), pa.array(np.concatenate([[n], one, two[i, j]]).astype(np.float64))],
                names=["i", "j", "value"],
            )

    cells = rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    if not cells:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = 1 + max(r.j for r in cells)
    n, one, two = 0, np.zeros(d), np.zeros((d, d))
    for r in cells:
        if r.i == -2:
            n = int(r.value)
        elif r.i == -1:
            one[r.j] = r.value
        else:
            two[r.i, r.j] = two[r.j, r.i] = r.value
    return n, one, two


@dataclass(frozen=True)
class Moments:
    """Count, means, and centred sums of products."""

    n: int
    mean: np.ndarray
    centred: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.centred / max(1, self.n - 1)


def moments(df: DataFrame, names: Sequence[str]) -> Moments:
    """Of number columns and array columns, side by side. The wide form takes two passes, the mean first, so that large means do not cancel."""
    array = any(is_vector(df, c) for c in names)
    d = len(names)
    if not array and d <= NARROW:
        aggregates = [F.count(F.lit(1)).alias("n"), *(F.avg(numeric(df, c)).alias(f"m_{i}") for i, c in enumerate(names))]
        aggregates += [F.covar_pop(numeric(df, names[i]), numeric(df, names[j])).alias(f"s_{i}_{j}") for i, j in pairs(d)]
        row = df.agg(*aggregates).first()
        if not row.n:
            raise ValueError("no rows")
        centred = np.zeros((d, d))
        for i, j in pairs(d):
            centred[i, j] = centred[j, i] = row[f"s_{i}_{j}"] * row.n
        return Moments(row.n, np.array([row[f"m_{i}"] for i in range(d)]), centred)
    rows = feature_columns(df, names)
    n, one, _ = wide_sums(rows)
    if not n:
        raise ValueError("no rows")
    mean = one / n
    n, rest, two = wide_sums(rows, mean)
    return Moments(n, mean, two - np.outer(rest, rest) / n)


def gram(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """X'X as a matrix on the driver, d x d."""
    if len(names) <= NARROW and not any(is_vector(df, c) for c in names):
        out = np.zeros((len(names), len(names)))
        for r in gram_frame(df, names).collect():
            out[r.i, r.j] = r.value or 0.0
        return out
    return wide_sums(feature_columns(df, names))[2]


def feature_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The number and array columns of that name, as doubles."""
    return df.select(*(vector(df, c) if is_vector(df, c) else numeric(df, c) for c in names))
