"""Linear and ridge regression by normal equations, logistic regression by gradient descent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.expr import SIGMOID_LIMIT, column, linear, positive, sigmoid
from quillspark.operators.gram import feature_columns, gram, moments
from quillspark.operators.vectors import combined, dot, is_vector, vector, width
from quillspark.sources.features import numeric, to_features

#: Added to the diagonal where no ridge is asked for, and put in place of vanishing pivots.
JITTER = 1e-6
#: More features are fitted by conjugate gradients; their steps at most, and the relative residual that ends them.
WIDE, STEPS, SETTLED = 2_000, 1_000, 1e-13
_PIVOT = 1e-12


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky; if a pivot vanishes, elimination with row pivoting and jittered pivots."""
    try:
        factor = np.linalg.cholesky(a)
        if (np.diag(factor) ** 2 > _PIVOT).all():
            return np.linalg.solve(factor.T, np.linalg.solve(factor, b))
    except np.linalg.LinAlgError:
        pass
    m = np.column_stack([a, b]).astype(float)
    n = len(b)
    for k in range(n):
        swap = k + int(np.argmax(np.abs(m[k:, k])))
        m[[k, swap]] = m[[swap, k]]
        if abs(m[k, k]) < _PIVOT:
            m[k, k] = JITTER
        m[k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k])
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, -1] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x


def score(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """weights . features + bias, where the features are columns or one array column."""
    if len(weights) != len(features):
        return dot(features[0], list(weights)) + F.lit(float(bias))
    return linear(features, weights, bias)


@dataclass(frozen=True)
class LinearRegressionModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    alpha: float = 0.0
    fit_intercept: bool = True

    @property
    def n_features(self) -> int:
        return len(self.weights)

    def expr(self) -> Column:
        return score(self.features, self.weights, self.intercept)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.expr())


class LinearRegression:
    """Least squares with an optional ridge `alpha` on the sum scale; the intercept is not penalized. One aggregate. The features may be one array column.

    `normal` sums and solves the d x d normal equations. `gradients` never forms them: each
    step of conjugate gradients, preconditioned by the norms of the columns, is one job
    that multiplies the rows with a vector and back, d numbers a task. `auto` takes the
    second form for more than `WIDE` features.
    """

    def __init__(self, alpha: float = 0.0, fit_intercept: bool = True, solver: str = "auto"):
        if alpha < 0:
            raise ValueError("alpha must not be negative")
        if solver not in ("auto", "normal", "gradients"):
            raise ValueError(f"unknown solver {solver!r}")
        self.alpha, self.fit_intercept, self.solver = float(alpha), fit_intercept, solver

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearRegressionModel:
        names = [*features, label]
        if len(features) > 1 and any(is_vector(df, c) for c in features):
            raise TypeError("an array column stands alone, without other features")
        ridge = self.alpha if self.alpha > 0 else JITTER
        if self.solver == "gradients" or self.solver == "auto" and width(df, features) > WIDE:
            return self._by_gradients(df, features, label, ridge)
        if self.fit_intercept:
            m = moments(df, names)
            sums, mean = m.centred, m.mean
        else:
            sums = gram(df, names)
            mean = np.zeros(len(sums))
        d = len(mean) - 1
        weights = solve_spd(sums[:d, :d] + np.eye(d) * ridge, sums[:d, d])
        intercept = float(mean[d] - weights @ mean[:d]) if self.fit_intercept else 0.0
        return LinearRegressionModel(tuple(features), tuple(map(float, weights)), intercept, self.alpha, self.fit_intercept)

    def _by_gradients(self, df: DataFrame, features: Sequence[str], label: str, ridge: float) -> LinearRegressionModel:
        rows = feature_columns(df, [*features, label]).persist()
        try:
            sums = combined(rows, lambda m: np.append(m.sum(0), len(m)))
            if sums is None:
                raise ValueError("no rows")
            mean = sums[:-1] / sums[-1] if self.fit_intercept else np.zeros(len(sums) - 1)

            def start(m: np.ndarray) -> np.ndarray:
                m = m - mean
                return np.concatenate([m[:, :-1].T @ m[:, -1], (m[:, :-1] ** 2).sum(0)])

            def product(m: np.ndarray, p: np.ndarray) -> np.ndarray:
                x = m[:, :-1] - mean[:-1]
                return x.T @ (x @ p)

            right, norms = np.split(combined(rows, start), 2)
            norms = norms + ridge
            w, r = np.zeros(len(right)), right.copy()
            p = r / norms
            size, target = r @ p, SETTLED**2 * (right @ (right / norms))
            for _ in range(STEPS):
                if size <= target:
                    break
                q = combined(rows, lambda m, p=p: product(m, p)) + ridge * p
                step = size / (p @ q)
                w, r = w + step * p, r - step * q
                z = r / norms
                size, last = r @ z, size
                p = z + size / last * p
        finally:
            rows.unpersist()
        intercept = float(mean[-1] - w @ mean[:-1]) if self.fit_intercept else 0.0
        return LinearRegressionModel(tuple(features), tuple(map(float, w)), intercept, self.alpha, self.fit_intercept)


@dataclass(frozen=True)
class LogisticRegressionModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def probability(self) -> Column:
        return sigmoid(score(self.features, self.weights, self.bias))

    def expr(self) -> Column:
        p = self.probability()
        return F.when((p >= 0.5) & ~F.isnan(p), 1.0).otherwise(0.0)

    def transform(self, df: DataFrame, output: str = "prediction", probability: str | None = None) -> DataFrame:
        out = df.withColumn(output, self.expr())
        return out.withColumn(probability, self.probability()) if probability else out


class LogisticRegression:
    """Gradient descent for a fixed number of epochs at a decaying rate, from zero weights.

    `batch` takes the mean gradient of all rows: one aggregate an epoch, d + 1 numbers
    to the driver. `sgd` updates row by row: each partition goes through its rows in
    the order of the row id from the weights of the last epoch, and the results are
    averaged by rows; with a single partition that is the plain sequential method.
    """

    def __init__(self, learning_rate: float = 0.05, epochs: int = 50, l2: float = 0.001, solver: str = "batch"):
        if solver not in ("batch", "sgd"):
            raise ValueError(f"unknown solver {solver!r}")
        self.learning_rate, self.epochs, self.l2, self.solver = learning_rate, epochs, l2, solver

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id_col: str | None = None) -> LogisticRegressionModel:
        if self.solver == "sgd" and not id_col:
            raise ValueError("sgd needs a row id for the order of the rows")
        if any(is_vector(df, c) for c in features):
            if len(features) > 1 or self.solver == "sgd":
                raise TypeError("an array column stands alone, and is fitted by batch descent")
            return self._fit_vectors(df, features[0], label)
        rows = to_features(df, features, label, id_col)
        if self.solver == "sgd":
            rows = rows.sortWithinPartitions(column(id_col))
        rows = rows.persist()
        try:
            w, b = np.zeros(len(features)), 0.0
            for epoch in range(self.epochs):
                step = self._batch if self.solver == "batch" else self._sequential
                w, b = step(rows, features, label, w, b, self.learning_rate / (1 + 0.01 * epoch))
        finally:
            rows.unpersist()
        return LogisticRegressionModel(tuple(features), tuple(map(float, w)), float(b))

    def _fit_vectors(self, df: DataFrame, name: str, label: str) -> LogisticRegressionModel:
        """Batch descent on an array column: a task adds up its part of the gradient."""
        rows, w, b = df.select(vector(df, name), numeric(df, label)).persist(), None, 0.0

        def slope(m: np.ndarray, w: np.ndarray | None, b: float) -> np.ndarray:
            x = m[:, :-1]
            z = np.full(len(x), b) if w is None else x @ w + b
            off = np.where(z > SIGMOID_LIMIT, 1.0, np.where(z < -SIGMOID_LIMIT, 0.0, 1 / (1 + np.exp(-np.clip(z, -SIGMOID_LIMIT, SIGMOID_LIMIT))))) - (m[:, -1] > 0.5)
            return np.concatenate([off @ x, [off.sum(), len(x)]])

        try:
            for epoch in range(self.epochs):
                sums = combined(rows, lambda m, w=w, b=b: slope(m, w, b))
                if sums is None:
                    raise ValueError("no rows")
                w = np.zeros(len(sums) - 2) if w is None else w
                rate = self.learning_rate / (1 + 0.01 * epoch)
                w, b = w - rate * (sums[:-2] / sums[-1] + self.l2 * w), b - rate * sums[-2] / sums[-1]
        finally:
            rows.unpersist()
        return LogisticRegressionModel((name,), tuple(map(float, () if w is None else w)), float(b))

    def _batch(self, rows, features, label, w, b, rate):
        off = sigmoid(linear(features, w, b)) - F.when(positive(column(label)), 1.0).otherwise(0.0)
        means = rows.select(off.alias("off"), *(column(c).alias(f"f{j}") for j, c in enumerate(features))).agg(F.avg("off"), *(F.avg(F.col("off") * F.col(f"f{j}")) for j in range(len(features)))).first()
        if means[0] is None:
            raise ValueError("no rows")
        return w - rate * (np.array(means[1:], float) + self.l2 * w), b - rate * means[0]

    def _sequential(self, rows, features, label, w, b, rate):
        l2, names = self.l2, [*features, label]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_w, own_b, n = w.copy(), b, 0
            for batch in batches:
                m = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1)
                for row in m:
                    z = row[:-1] @ own_w + own_b
                    p = 1.0 if z > 20 else 0.0 if z < -20 else 1 / (1 + np.exp(-z))
                    off = p - (1.0 if row[-1] > 0.5 else 0.0)
                    own_b -= rate * off
                    own_w -= rate * (off * row[:-1] + l2 * own_w)
                    n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([*(own_w * n), own_b * n, float(n)]), pa.array(np.arange(len(own_w) + 2), pa.int32())], names=["value", "k"])

        sums = rows.mapInArrow(run, "value double, k int").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
        if not sums:
            raise ValueError("no rows")
        values = np.array([r.value for r in sums]) / sums[-1].value
        return values[:-2], values[-2]


def project(df: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]], prefix: str = "y") -> DataFrame:
    """X W for a d x k matrix of weights: columns `<prefix>0` to `<prefix>k-1` appended."""
    w = np.asarray(weights, float)
    if w.ndim != 2 or w.shape[0] != len(features):
        raise ValueError("one row of weights for each feature is needed")
    return df.select("*", *(linear(features, w[:, k]).alias(f"{prefix}{k}") for k in range(w.shape[1])))


