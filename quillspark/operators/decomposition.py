"""Principal components: from one covariance with exact eigenvectors, or for wide data from products of the rows with blocks of vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.expr import column, linear
from quillspark.operators.gram import feature_columns, moments
from quillspark.operators.vectors import combined, width

#: Wider data is decomposed without its covariance.
WIDE = 2_000
#: Vectors of a block beside the components asked for; blocks at most; relative change of the variances that ends the search.
SPARE, BLOCKS, SETTLED = 10, 24, 1e-12


@dataclass(frozen=True)
class PCAModel:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained_variance: tuple[float, ...]
    explained_variance_ratio: tuple[float, ...]

    @property
    def n_components(self) -> int:
        return len(self.components)

    @property
    def n_features(self) -> int:
        return len(self.mean)

    def expr(self, k: int) -> Column:
        w = self.components[k]
        return linear(self.features, w, -float(np.dot(w, self.mean)))

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Columns `<prefix>0`...: the centred row times each component."""
        if len(self.features) == 1 and self.n_features > 1:
            parts = [F.aggregate(F.zip_with(column(self.features[0]), F.array(*map(F.lit, w)), lambda x, y: x.cast("double") * y), F.lit(-float(np.dot(w, self.mean))), lambda s, x: s + x) for w in self.components]
        else:
            parts = [self.expr(k) for k in range(self.n_components)]
        return df.select("*", *(p.alias(f"{prefix}{k}") for k, p in enumerate(parts)))

    def inverse(self, df: DataFrame, prefix: str = "pc", output: str = "back_") -> DataFrame:
        """Columns `<output><feature>` from the component columns."""
        scores = [f"{prefix}{k}" for k in range(self.n_components)]
        return df.select("*", *(linear(scores, [w[j] for w in self.components], self.mean[j]).alias(f"{output}{c}") for j, c in enumerate(self.features)))


class PCA:
    """The first components by variance; each is signed so that its largest coefficient is positive.

    `exact` sums the d x d covariance and takes its eigenvectors on the driver. `krylov`
    never forms it: each job multiplies the rows with a block of `n_components + SPARE`
    vectors and back, so tasks and driver hold d numbers for each vector; the blocks of
    all jobs span the space in which the components are sought, until their variances no
    longer change. `auto` takes the second form for more than `WIDE` features.
    """

    def __init__(self, n_components: int = 2, solver: str = "auto", seed: int = 42):
        if n_components <= 0:
            raise ValueError("at least one component is needed")
        if solver not in ("auto", "exact", "krylov"):
            raise ValueError(f"unknown solver {solver!r}")
        self.n_components, self.solver, self.seed = n_components, solver, seed

    def fit(self, df: DataFrame, features: Sequence[str]) -> PCAModel:
        """`features`: number columns, or one array column."""
        if self.solver == "krylov" or self.solver == "auto" and width(df, features) > WIDE:
            return self._krylov(feature_columns(df, features), features)
        m = moments(df, features)
        value, vector = np.linalg.eigh(m.covariance)
        order = np.argsort(-value)[: min(self.n_components, len(value))]
        return self._model(features, m.mean, vector[:, order].T, value[order], float(np.trace(m.covariance)))

    def _model(self, features: Sequence[str], mean: np.ndarray, components: np.ndarray, value: np.ndarray, whole: float) -> PCAModel:
        largest = components[np.arange(len(components)), np.argmax(np.abs(components), axis=1)]
        components = components * np.where(largest < 0, -1.0, 1.0)[:, None]
        variance = np.maximum(value, 0.0)
        return PCAModel(tuple(features), tuple(map(float, mean)), tuple(tuple(map(float, c)) for c in components), tuple(map(float, variance)), tuple(float(v / whole) if whole > 0 else 0.0 for v in variance))

    def _krylov(self, rows: DataFrame, features: Sequence[str]) -> PCAModel:
        rows = rows.persist()
        try:
            sums = combined(rows, lambda x: np.append(x.sum(0), len(x)))
            if sums is None:
                raise ValueError("no rows")
            mean, n = sums[:-1] / sums[-1], int(sums[-1])
            d, k = len(mean), min(self.n_components, len(mean))
            #: A block, and beside it the total variance, which the first job gives too.
            block = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(d, min(d, k + SPARE))))[0]
            basis, image, before = np.zeros((d, 0)), np.zeros((d, 0)), None
            for _ in range(BLOCKS):

                def product(x: np.ndarray, q: np.ndarray = block) -> np.ndarray:
                    x = x - mean
                    return np.append((x.T @ (x @ q)).ravel(), (x**2).sum())

                found = combined(rows, product) / max(1, n - 1)
                whole, of_block = float(found[-1]), found[:-1].reshape(block.shape)
                basis, image = np.column_stack([basis, block]), np.column_stack([image, of_block])
                small = basis.T @ image
                value, vector = np.linalg.eigh((small + small.T) / 2)
                order = np.argsort(-value)[:k]
                if basis.shape[1] == d or before is not None and np.abs(value[order] - before).max() <= SETTLED * max(abs(value[order[0]]), 1e-300):
                    break
                before = value[order]
                for _ in range(2):
                    of_block = of_block - basis @ (basis.T @ of_block)
                left, size, _ = np.linalg.svd(of_block, full_matrices=False)
                keep = (size > 1e-13 * max(abs(value[order[0]]), 1e-300))[: d - basis.shape[1]]
                block = left[:, : len(keep)][:, keep]
                block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
                if not block.shape[1]:
                    break
        finally:
            rows.unpersist()
        return self._model(features, mean, (basis @ vector[:, order]).T, value[order], whole)
