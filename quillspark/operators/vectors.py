"""Dense vectors: one array column (or number columns) as matrices, batch by batch, with elementwise partial aggregates.

A task adds up an array of numbers of a fixed shape over all its batches and hands on
one row for each of them; Spark adds those by place. So what is shuffled and what
reaches the driver depends on the shape, never on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expr import column, literals
from quillspark.sources.features import NUMERIC, resolve

_MERGE = {"sum": (np.add, F.sum), "min": (np.fmin, F.min), "max": (np.fmax, F.max)}


def is_vector(df: DataFrame, name: str) -> bool:
    kind = df.schema[resolve(df, name)].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, NUMERIC)


def vector(df: DataFrame, name: str) -> Column:
    """An array column as doubles; a null, or a null within, is an error."""
    c = column(resolve(df, name))
    value = c.cast("array<double>")
    return F.when(c.isNull() | F.exists(value, lambda v: v.isNull()), F.raise_error(F.lit(f"null in column {name}"))).otherwise(value).alias(name)


def width(df: DataFrame, features: list[str] | tuple[str, ...]) -> int:
    """The number of features: of columns, or of places in the first row of an array column."""
    if len(features) == 1 and is_vector(df, features[0]):
        first = df.select(F.size(vector(df, features[0])).alias("d")).first()
        return first.d if first else 0
    return len(features)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of an Arrow batch: arrays of equal lengths and numbers, side by side."""
    parts = []
    for c in batch.columns:
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            sizes, flat = c.value_lengths().to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(sizes) and (sizes != sizes[0]).any():
                raise ValueError("vectors of different lengths")
            parts.append(flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0)))
        else:
            parts.append(c.to_numpy(zero_copy_only=False).astype(np.float64)[:, None])
    return np.concatenate(parts, axis=1)


def appended(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *extra: T.StructField) -> DataFrame:
    """`df` and the columns that `run` puts behind those of its batches, which it knows by place, so that names with dots do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def combined(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], how: str = "sum") -> np.ndarray | None:
    """`part` of the matrix of each batch, merged over all of them; flat, None without rows."""
    merge, aggregate = _MERGE[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = np.asarray(part(matrix(batch)), np.float64).ravel()
                if total is not None and len(own) != len(total):
                    raise ValueError("vectors of different lengths")
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "value"])

    found = rows.mapInArrow(run, "i long, value double").groupBy("i").agg(aggregate("value").alias("value"), F.count("value").alias("parts")).toArrow()
    if not found.num_rows:
        return None
    if len(set(found.column("parts").to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    out = np.zeros(found.num_rows)
    out[found.column("i").to_numpy()] = found.column("value").to_numpy()
    return out


def dot(name: str, weights: list[float]) -> Column:
    """Inner product of an array column with fixed weights."""
    return F.aggregate(F.zip_with(column(name).cast("array<double>"), literals(weights, "double"), lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
