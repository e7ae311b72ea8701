"""Fits straight from a DataFrame, one call each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillspark.operators.clustering import KMeans, KMeansModel
from quillspark.operators.decomposition import PCA, PCAModel
from quillspark.operators.linear import LinearRegression, LinearRegressionModel, LogisticRegression, LogisticRegressionModel
from quillspark.operators.preprocessing import MinMaxScaler, OneHotEncoder, OneHotModel, ScalerModel, SparseOneHotModel, StandardScaler, VectorScalerModel
from quillspark.operators.trees import DecisionTree, DecisionTreeModel, RandomForest, RandomForestModel
from quillspark.sources.features import resolve


def _named(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [resolve(df, c) for c in names]


def fit_standard_scaler(df: DataFrame, features: Sequence[str]) -> ScalerModel | VectorScalerModel:
    return StandardScaler().fit(df, _named(df, features))


def fit_minmax_scaler(df: DataFrame, features: Sequence[str]) -> ScalerModel | VectorScalerModel:
    return MinMaxScaler().fit(df, _named(df, features))


def fit_one_hot(df: DataFrame, name: str, id_col: str) -> OneHotModel:
    return OneHotEncoder().fit(df, resolve(df, name), id_col)


def fit_sparse_one_hot(df: DataFrame, name: str, id_col: str) -> SparseOneHotModel:
    return OneHotEncoder().fit_sparse(df, resolve(df, name), id_col)


def fit_linear(df: DataFrame, label: str, features: Sequence[str], alpha: float = 0.0, fit_intercept: bool = True) -> LinearRegressionModel:
    return LinearRegression(alpha, fit_intercept).fit(df, _named(df, features), resolve(df, label))


def fit_logistic(df: DataFrame, label: str, features: Sequence[str], learning_rate: float = 0.05, epochs: int = 50, l2: float = 0.001) -> LogisticRegressionModel:
    return LogisticRegression(learning_rate, epochs, l2).fit(df, _named(df, features), resolve(df, label))


def fit_decision_tree(df: DataFrame, label: str, features: Sequence[str], id_col: str, max_depth: int = 6, min_samples_split: int = 2) -> DecisionTreeModel:
    return DecisionTree(max_depth, min_samples_split).fit(df, _named(df, features), resolve(df, label), id_col)


def fit_random_forest(df: DataFrame, label: str, features: Sequence[str], id_col: str, num_trees: int = 100, max_depth: int = 8, min_samples_split: int = 2, subsample_ratio: float = 0.8) -> RandomForestModel:
    return RandomForest(num_trees, max_depth, min_samples_split, subsample_ratio).fit(df, _named(df, features), resolve(df, label), id_col)


def fit_kmeans(df: DataFrame, features: Sequence[str], k: int = 8, max_iterations: int = 100, id_col: str | None = None) -> KMeansModel:
    return KMeans(k, max_iterations).fit(df, _named(df, features), id_col)


def fit_pca(df: DataFrame, features: Sequence[str], n_components: int = 2) -> PCAModel:
    return PCA(n_components).fit(df, _named(df, features))
