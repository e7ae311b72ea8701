"""What the estimators and models of this package have in common."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Transformer(Protocol):
    """Adds or replaces columns of a frame, batch or streaming; fitted values do not change."""

    def transform(self, df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame: ...


@runtime_checkable
class Predictor(Transformer, Protocol):
    """A transformer whose prediction is also a column expression."""

    def expr(self, *args: Any) -> Any: ...


@runtime_checkable
class Estimator(Protocol):
    """`fit` looks at a frame through aggregates and returns a fitted model; with a label column it is supervised."""

    def fit(self, df: DataFrame, *args: Any, **kwargs: Any) -> Transformer: ...
