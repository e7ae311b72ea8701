"""Column builders: vector arithmetic, distances, scores and bins as plain Spark expressions.

Comparisons follow IEEE 754, where NaN compares false; Spark orders NaN above all
numbers, so the guards are written out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this a sigmoid is 0 or 1.
SIGMOID_LIMIT = 20.0


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def literal_sql(values: Sequence[float], kind: str) -> str:
    """A constant array, however long, of `int`, `bigint` or `double` in SQL: one text, which the optimizer turns into values."""
    if not len(values):
        return f"cast(array() as array<{kind}>)"
    return f"cast(split('{','.join(map(repr, map(float if kind == 'double' else int, values)))}', ',') as array<{kind}>)"


def literals(values: Sequence[float], kind: str) -> Column:
    return F.expr(literal_sql(values, kind))


def linear(columns: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> Column:
    """weights . columns + bias"""
    return total([column(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]) + F.lit(float(bias))


def dot(a: Sequence[str], b: Sequence[str]) -> Column:
    return total([column(x) * column(y) for x, y in zip(a, b, strict=True)])


def squared_distance(columns: Sequence[str], point: Sequence[float]) -> Column:
    """Squared Euclidean distance to a fixed point."""
    return total([(column(c) - F.lit(float(p))) * (column(c) - F.lit(float(p))) for c, p in zip(columns, point, strict=True)])


def nearest(columns: Sequence[str], points: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest point, the lowest of equals; 0 if a value is NaN (then every distance is).

    The smallest distance is compared with each in turn: numbers only, no arrays, so it
    stays within generated code.
    """
    distances = [squared_distance(columns, p) for p in points]
    if len(distances) == 1:
        return F.lit(0)
    least = F.least(*distances)
    out = F.when(distances[0] == least, 0)
    for i, d in enumerate(distances[1:-1], 1):
        out = out.when(d == least, i)
    return out.otherwise(len(distances) - 1).cast("int")


def sigmoid(z: Column) -> Column:
    """Logistic function, clamped to 0 and 1 beyond the limit; NaN stays NaN."""
    return F.when(F.isnan(z), z).when(z > SIGMOID_LIMIT, 1.0).when(z < -SIGMOID_LIMIT, 0.0).otherwise(1.0 / (1.0 + F.exp(-z)))


def positive(label: Column) -> Column:
    """Whether a label counts as class 1; NaN does not."""
    return (label > 0.5) & ~F.isnan(label)


def bin_index(value: Column, thresholds: Sequence[float]) -> Column:
    """How many leading thresholds the value exceeds; a value equal to one stays below it, NaN falls in bin 0."""
    if len(thresholds) > 255:
        raise ValueError("at most 255 thresholds")
    #: The first threshold that is not exceeded, found by halving: eight comparisons for 255 of them. In order of the largest so far, which exceeding all of the leading ones means.
    tops = [max(map(float, thresholds[: i + 1])) for i in range(len(thresholds))]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > tops[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(F.isnan(value), F.lit(0)).otherwise(search(0, len(tops))).cast("int")


def array_add(a: Column, b: Column) -> Column:
    """Elementwise sum; arrays of different lengths are an error."""
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def array_fma(a: Column, scalar: float, b: Column) -> Column:
    """a * scalar + b, elementwise."""
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x.cast("double") * F.lit(float(scalar)) + y.cast("double")))


def array_dot(a: Column, b: Column) -> Column:
    """Over the length of `a`; a shorter `b` is an error."""
    return F.aggregate(F.zip_with(a, _reaching(a, b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, _reaching(a, b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("arrays differ in length"))).otherwise(value)


def _reaching(a: Column, b: Column) -> Column:
    return F.when(F.size(b) < F.size(a), F.raise_error(F.lit("the second array is shorter"))).otherwise(F.slice(b, F.lit(1), F.size(a)))
