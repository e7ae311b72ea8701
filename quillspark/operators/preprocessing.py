"""Scalers and one-hot encoding: one aggregate to fit, a projection to apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.expr import column, literals
from quillspark.operators.trees import positions
from quillspark.operators.vectors import combined, is_vector, vector
from quillspark.sources.features import NUMERIC, numeric, resolve

#: Smaller spreads count as none; the divisor is then 1.
TINY = 1e-8


@dataclass(frozen=True)
class ScalerModel:
    """(x - shift) / scale by column."""

    names: tuple[str, ...]
    shifts: tuple[float, ...]
    scales: tuple[float, ...]

    def expr(self, name: str, value: Column | None = None) -> Column:
        i = [n.lower() for n in self.names].index(name.lower())
        return ((column(name) if value is None else value) - F.lit(self.shifts[i])) / F.lit(self.scales[i])

    def transform(self, df: DataFrame) -> DataFrame:
        """The fitted columns scaled, all others as they are; works on streaming frames too."""
        own = {resolve(df, n): n for n in self.names}
        return df.select(*(self.expr(own[c], numeric(df, c, "keep")).alias(c) if c in own else column(c) for c in df.columns))


class StandardScalerModel(ScalerModel):
    @property
    def means(self) -> tuple[float, ...]:
        return self.shifts

    @property
    def std_devs(self) -> tuple[float, ...]:
        return self.scales


class MinMaxScalerModel(ScalerModel):
    @property
    def mins(self) -> tuple[float, ...]:
        return self.shifts

    @property
    def maxs(self) -> tuple[float, ...]:
        return tuple(a + b for a, b in zip(self.shifts, self.scales, strict=True))


def standard_params(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: `<name>_mean` and `<name>_std` (population; 1 where there is no spread)."""
    out = []
    for c in names:
        std = F.stddev_pop(numeric(df, c, "keep"))
        out += [F.avg(numeric(df, c, "keep")).alias(f"{c}_mean"), F.when(std <= TINY, 1.0).otherwise(std).alias(f"{c}_std")]
    return df.agg(*out)


def minmax_params(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: `<name>_min` and `<name>_range` (1 where there is no spread). NaN is passed over."""
    out = []
    for c in names:
        x = numeric(df, c, "keep")
        x = F.when(~F.isnan(x), x)
        spread = F.max(x) - F.min(x)
        out += [F.min(x).alias(f"{c}_min"), F.when(spread <= TINY, 1.0).otherwise(spread).alias(f"{c}_range")]
    return df.agg(*out)


def _fitted(row, names: Sequence[str], kind: type, shift: str, scale: str):
    if any(row[f"{c}_{shift}"] is None for c in names):
        raise ValueError("nothing to fit: no rows, or a column without numbers")
    return kind(tuple(names), tuple(row[f"{c}_{shift}"] for c in names), tuple(row[f"{c}_{scale}"] for c in names))


@dataclass(frozen=True)
class VectorScalerModel:
    """(x - shift) / scale for each place of an array column."""

    name: str
    shifts: tuple[float, ...]
    scales: tuple[float, ...]

    def expr(self) -> Column:
        shifts, scales = literals(self.shifts, "double"), literals(self.scales, "double")
        return F.transform(column(self.name).cast("array<double>"), lambda x, i: (x - F.get(shifts, i)) / F.get(scales, i))

    def transform(self, df: DataFrame) -> DataFrame:
        """The array column scaled, all others as they are; stays within Spark's own functions."""
        return df.withColumn(resolve(df, self.name), self.expr())


def _vector_scaler(name: str, shifts: np.ndarray | None, scales: np.ndarray | None) -> VectorScalerModel:
    if shifts is None or not (np.isfinite(shifts).all() and np.isfinite(scales).all()):
        raise ValueError("nothing to fit: no rows, or a place without numbers")
    return VectorScalerModel(name, tuple(shifts.tolist()), tuple(np.where(scales <= TINY, 1.0, scales).tolist()))


class StandardScaler:
    """Zero mean, unit population deviation; one aggregate for all columns. An array column is scaled place by place, in two passes."""

    def fit(self, df: DataFrame, names: Sequence[str]) -> StandardScalerModel | VectorScalerModel:
        if len(names) == 1 and is_vector(df, names[0]):
            rows = df.select(vector(df, names[0]))
            sums = combined(rows, lambda x: np.append(x.sum(0), len(x)))
            if sums is None:
                return _vector_scaler(names[0], None, None)
            mean = sums[:-1] / sums[-1]
            return _vector_scaler(names[0], mean, np.sqrt(combined(rows, lambda x: ((x - mean) ** 2).sum(0)) / sums[-1]))
        return _fitted(standard_params(df, names).first(), names, StandardScalerModel, "mean", "std")


class MinMaxScaler:
    """To [0, 1] by the fitted range; unseen values are not clamped. An array column is scaled place by place."""

    def fit(self, df: DataFrame, names: Sequence[str]) -> MinMaxScalerModel | VectorScalerModel:
        if len(names) == 1 and is_vector(df, names[0]):
            ends = combined(df.select(vector(df, names[0])), lambda x: np.concatenate([np.fmin.reduce(x), np.fmin.reduce(-x)]), "min")
            return _vector_scaler(names[0], *((None, None) if ends is None else (ends[: len(ends) // 2], -ends[len(ends) // 2 :] - ends[: len(ends) // 2])))
        return _fitted(minmax_params(df, names).first(), names, MinMaxScalerModel, "min", "range")


@dataclass(frozen=True)
class OneHotModel:
    name: str
    categories: tuple[int | str, ...]

    @property
    def num_categories(self) -> int:
        return len(self.categories)

    def expr(self, i: int) -> Column:
        return F.when(column(self.name) == F.lit(self.categories[i]), 1.0).otherwise(0.0)

    def transform(self, df: DataFrame, prefix: str = "onehot_", start: int = 0) -> DataFrame:
        """Columns `<prefix><start + i>`; an unknown or null category is zero in all."""
        return df.select("*", *(self.expr(i).alias(f"{prefix}{start + i}") for i in range(self.num_categories)))


@dataclass(frozen=True)
class SparseOneHotModel:
    """Any number of categories: a kept table (category, index), joined to the rows."""

    name: str
    table: DataFrame
    num_categories: int

    def transform(self, df: DataFrame, output: str = "onehot") -> DataFrame:
        """`output`: size, indices and values of each row's one-hot vector, which has one value, or none for an unknown or null category.

        The table is broadcast only if Spark finds it small; otherwise both sides are
        shuffled by category, and Spark splits a category with very many rows.
        """
        own = _category(df, self.name)
        index = f"_{output}_index"
        table = self.table.select(F.col("category").alias(f"_{output}_category"), F.col("index").alias(index))
        joined = df.join(table, own == table[f"_{output}_category"], "left")
        hit = F.col(index).isNotNull()
        sparse = F.struct(
            F.lit(self.num_categories).cast("long").alias("size"),
            F.when(hit, F.array(index)).otherwise(F.array().cast("array<bigint>")).alias("indices"),
            F.when(hit, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
        )
        return joined.select(*(column(c) for c in df.columns), sparse.alias(output))

    def unpersist(self) -> None:
        self.table.unpersist()


def _category(df: DataFrame, name: str) -> Column:
    """Number categories are whole numbers; others stay as they are."""
    c = column(resolve(df, name))
    return c.cast("long") if isinstance(df.schema[resolve(df, name)].dataType, NUMERIC) else c


def category_order(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """(category, first_id): the order of first occurrence by row id, from a partial minimum."""
    return df.filter(column(resolve(df, name)).isNotNull()).groupBy(_category(df, name).alias("category")).agg(F.min(column(id_col)).alias("first_id"))


class OneHotEncoder:
    """Categories, numbers or strings, in the order of their first occurrence. The row id gives that order; a frame has none of its own."""

    def __init__(self, max_categories: int = 10_000):
        self.max_categories = max_categories

    def fit(self, df: DataFrame, name: str, id_col: str) -> OneHotModel:
        """For few categories: a column each."""
        rows = category_order(df, name, id_col).orderBy("first_id", "category").limit(self.max_categories + 1).collect()
        if len(rows) > self.max_categories:
            raise ValueError(f"more than {self.max_categories} categories; fit_sparse takes any number")
        return OneHotModel(name, tuple(r.category for r in rows))

    def fit_sparse(self, df: DataFrame, name: str, id_col: str) -> SparseOneHotModel:
        """For any number of categories: a table of them, numbered within ranges of the first row id; only counts by range reach the driver."""
        order = category_order(df, name, id_col).persist()
        try:
            numbered, n = positions(order, "first_id", "category")
            table = numbered.select("category", F.col("pos").alias("index")).persist()
            table.count()
        finally:
            order.unpersist()
        return SparseOneHotModel(name, table, n)
