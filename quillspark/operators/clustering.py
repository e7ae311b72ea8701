"""k-means: seeding by oversampled rounds (k-means||), then one aggregate per iteration."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expr import column, nearest, squared_distance
from quillspark.operators.vectors import appended, combined, is_vector, matrix, vector
from quillspark.sources.features import resolve, spread, to_features

#: Beyond so many literals (centroids x features) rows are assigned in Arrow batches.
EXPRESSION_LITERALS = 512
#: Rows and points with larger values are measured directly, as their squares may overflow.
LARGEST = 1e140
#: From so many points on they are compared in groups.
GROUPED = 128
#: Up to so many literals seeding compares rows with points by an expression.
SEED_LITERALS = 64
#: A round of seeding draws so many rows for each cluster on average, and so many at least; there are two rounds, and more while there are fewer rows than clusters.
OVERSAMPLING, LEAST_DRAWS, ROUNDS = 2, 24, 2


@dataclass(frozen=True)
class KMeansModel:
    features: tuple[str, ...]
    centroids: tuple[tuple[float, ...], ...]
    iterations: int = 0

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def dimensions(self) -> int:
        return len(self.centroids[0])

    @property
    def centroid_norms_sq(self) -> tuple[float, ...]:
        return tuple(float(sum(x * x for x in c)) for c in self.centroids)

    def expr(self) -> Column:
        return nearest(self.features, self.centroids)

    def transform(self, df: DataFrame, output: str = "cluster") -> DataFrame:
        """The number of the nearest centroid beside each row; no shuffle."""
        array = len(self.features) == 1 and is_vector(df, self.features[0])
        if not array and self.k * self.dimensions <= EXPRESSION_LITERALS:
            return df.withColumn(output, self.expr())
        nearest_to = NearestPoints(np.array(self.centroids))
        places, names = [df.columns.index(resolve(df, c)) for c in self.features], [*df.columns, output]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(i) for i in places]
                x = columns[0].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if array else np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_to(x.astype(np.float64)))], names=names)

        return appended(df, run, T.StructField(output, T.IntegerType()))

    def frame(self, spark) -> DataFrame:
        """(cluster, dimension, value) of the centroids."""
        return spark.createDataFrame([(i, j, float(x)) for i, c in enumerate(self.centroids) for j, x in enumerate(c)], "cluster int, dimension int, value double")


class NearestPoints:
    """The nearest of fixed points for each row of a matrix, the lowest of equals, 0 where a value is NaN.

    Matrix products give distances but for rounding; points that they leave within their
    error of the nearest are measured directly. Many points lie in groups around pivots: a
    row is compared with the pivots and with the nearest group, and then only with groups
    that the triangle inequality leaves a chance.
    """

    def __init__(self, points: np.ndarray, grouped: int = GROUPED):
        self.points, self.norms = points, (points**2).sum(1)
        self.groups: list[np.ndarray] = []
        if len(points) >= grouped and (np.abs(points) <= LARGEST).all():
            #: Pivots as far apart as can be, about as many as points in a group.
            far, pivots = ((points - points[0]) ** 2).sum(1), [0]
            for _ in range(int(len(points) ** 0.5) - 1):
                pivots.append(int(far.argmax()))
                far = np.minimum(far, ((points - points[pivots[-1]]) ** 2).sum(1))
            own = ((points[:, None] - points[pivots][None]) ** 2).sum(2).argmin(1)
            self.groups = [np.flatnonzero(own == g) for g in range(len(pivots)) if (own == g).any()]
            self.centres = np.stack([points[g].mean(0) for g in self.groups])
            self.radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(1).max()) for g, c in zip(self.groups, self.centres, strict=True)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.points.shape[1] and len(x):
            raise ValueError("vectors of different lengths than the points")
        best = np.zeros(len(x), np.int32)
        real = np.flatnonzero((np.abs(x) <= LARGEST).all(1)) if self.groups else np.arange(len(x))
        if self.groups:
            best[real] = self._by_group(x[real])
            rest = np.setdiff1d(np.arange(len(x)), real)
            best[rest] = self._all(x[rest])
            return best
        return self._all(x)

    def _all(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, np.int32)
        with np.errstate(invalid="ignore", over="ignore"):
            rough = self.norms - 2 * (x @ self.points.T)
            near = ~(rough > rough.min(1, keepdims=True) + self._slack(x)[:, None])
        best = near.argmax(1).astype(np.int32)
        for i in np.flatnonzero(near.sum(1) > 1):
            best[i] = self._measured(x[i], np.flatnonzero(near[i]))
        return best

    def _slack(self, x: np.ndarray) -> np.ndarray:
        return 1e-12 * x.shape[1] * (self.norms.max() + (x**2).sum(1))

    def _measured(self, row: np.ndarray, some: np.ndarray) -> int:
        with np.errstate(invalid="ignore", over="ignore"):
            d = ((row - self.points[some]) ** 2).sum(1)
        return 0 if np.isnan(d).any() else int(some[np.argmin(d)])

    def _by_group(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, np.int32)
        own, slack = (x**2).sum(1), self._slack(x)
        away = np.sqrt(np.maximum(own[:, None] + (self.centres**2).sum(1) - 2 * (x @ self.centres.T), 0))
        low = np.maximum(away - self.radii, 0)
        low = np.maximum(low**2 * (1 - 1e-9) - 4 * slack[:, None], 0)
        least, first = np.full(len(x), np.inf), away.argmin(1)
        found_row, found_point, found_rough = [], [], []

        def compare(rows: np.ndarray, g: int) -> None:
            rough = own[rows, None] + self.norms[self.groups[g]] - 2 * (x[rows] @ self.points[self.groups[g]].T)
            least[rows] = np.minimum(least[rows], rough.min(1))
            i, j = np.nonzero(rough <= (least[rows] + slack[rows])[:, None])
            found_row.append(rows[i])
            found_point.append(self.groups[g][j])
            found_rough.append(rough[i, j])

        for g in range(len(self.groups)):
            rows = np.flatnonzero(first == g)
            if len(rows):
                compare(rows, g)
        for g in range(len(self.groups)):
            rows = np.flatnonzero((low[:, g] <= least + slack) & (first != g))
            if len(rows):
                compare(rows, g)
        row, point, rough = map(np.concatenate, (found_row, found_point, found_rough))
        keep = rough <= (least + slack)[row]
        row, point = row[keep], point[keep]
        order = np.lexsort((point, row))
        row, point = row[order], point[order]
        start = np.searchsorted(row, np.arange(len(x) + 1))
        best = point[start[:-1]].astype(np.int32)
        for i in np.flatnonzero(np.diff(start) > 1):
            best[i] = self._measured(x[i], point[start[i] : start[i + 1]])
        return best


def nearest_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return NearestPoints(points)(x)


class KMeans:
    """Lloyd's iterations from k-means++ seeds or given centroids.

    It stops when the largest squared shift of a centroid is under `tolerance`. An
    empty cluster moves to the origin, or with `empty="previous"` stays. With fewer
    rows than k there are as many clusters as rows.
    """

    def __init__(self, k: int = 8, max_iterations: int = 100, tolerance: float = 1e-4, seed: int = 42, initial_centroids: Sequence[Sequence[float]] | None = None, empty: str = "origin"):
        if k <= 0:
            raise ValueError("k must be positive")
        if empty not in ("origin", "previous"):
            raise ValueError(f"unknown rule for empty clusters {empty!r}")
        self.k, self.max_iterations, self.tolerance, self.seed, self.initial, self.empty = k, max_iterations, tolerance, seed, initial_centroids, empty

    def fit(self, df: DataFrame, features: Sequence[str], id_col: str | None = None) -> KMeansModel:
        """Features are number columns, or one array column. Drawn seeds depend on the row id, or on the values without one, not on how the rows are laid out."""
        if any(is_vector(df, c) for c in features):
            if len(features) > 1:
                raise TypeError("an array column stands alone, without other features")
            more = [column(resolve(df, id_col)).alias(id_col)] if id_col and self.initial is None else []
            rows = df.select(vector(df, features[0]), *more).persist()
        else:
            rows = to_features(df, features, id_col=id_col if self.initial is None else None).persist()
        try:
            centroids = [tuple(map(float, c)) for c in self.initial] if self.initial is not None else self._seeds(rows, features, id_col)
            done = 0
            for done in range(1, self.max_iterations + 1):
                fresh = self._step(rows, features, centroids)
                shift = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(centroids, fresh, strict=True))
                centroids = fresh
                if shift < self.tolerance:
                    break
        finally:
            rows.unpersist()
        return KMeansModel(tuple(features), tuple(centroids), done)

    def _step(self, rows: DataFrame, features: Sequence[str], centroids: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
        if is_vector(rows, features[0]):
            return self._vector_step(rows, features[0], centroids)
        names = [f"f{j}" for j in range(len(features))]
        points = rows.select(*(column(c).alias(n) for c, n in zip(features, names, strict=True)))
        assigned = KMeansModel(tuple(names), tuple(centroids)).transform(points, "cluster")
        means = {r["cluster"]: tuple(r[f"m{j}"] for j in range(len(names))) for r in assigned.groupBy("cluster").agg(*(F.avg(c).alias(f"m{j}") for j, c in enumerate(names))).collect()}
        rest = (lambda i: (0.0,) * len(features)) if self.empty == "origin" else (lambda i: centroids[i])
        return [means.get(i) or rest(i) for i in range(len(centroids))]

    def _vector_step(self, rows: DataFrame, name: str, centroids: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
        """Tasks assign their rows and add them up by cluster: k x (d + 1) numbers each."""
        points, nearest_to = np.array(centroids), NearestPoints(np.array(centroids))

        def part(x: np.ndarray) -> np.ndarray:
            member = np.zeros((len(x), len(points)))
            member[np.arange(len(x)), nearest_to(x)] = 1.0
            return np.column_stack([member.T @ x, member.sum(0)])

        sums = combined(rows.select(column(name)), part)
        if sums is None:
            return [(0.0,) * points.shape[1] if self.empty == "origin" else c for c in centroids]
        sums = sums.reshape(len(points), -1)
        means = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        return [tuple(m.tolist()) if n or self.empty == "origin" else c for m, n, c in zip(means, sums[:, -1], centroids, strict=True)]

    def _seeds(self, rows: DataFrame, features: Sequence[str], id_col: str | None = None) -> list[tuple[float, ...]]:
        """Seeds from two rounds of draws and a clustering of what they gave.

        In a round each row is drawn with a probability in proportion to its squared
        distance to the rows drawn before, which takes one job for the sum of distances and
        one for the draws. Each row counts for the nearest drawn one (one job); of the drawn
        rows, whose number depends on k alone, the driver takes k by D^2 sampling. Draws are hashes of
        the row id, or of the row's values without one. Rows with values that are not finite
        are not drawn. If there are fewer different rows than clusters the first seed is repeated.
        """
        names = [f"f{j}" for j in range(len(features))]
        own = column(id_col) if id_col else F.xxhash64(*map(column, features))
        keyed = rows.select(*(column(c).alias(n) for c, n in zip(features, names, strict=True)), own.alias("own"), F.coalesce(own.cast("string"), F.lit("null")).alias("key"))
        point = F.struct(*names, "own", "key")

        def unit(step: str) -> Column:
            return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.lit(step), F.col("key"))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)

        array = is_vector(rows, features[0])

        def flat(p) -> tuple[float, ...]:
            return tuple(p[0]) if array else tuple(p[: len(names)])

        odd = F.exists(F.col(names[0]) if array else F.array(*names), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        first = keyed.agg(F.count(F.lit(1)).alias("n"), F.min_by(point, F.struct(odd, unit("first"), "own", *names)).alias("p")).first()
        if not first.n:
            raise ValueError("no rows")
        k = min(self.k, first.n)
        keyed = spread(keyed, first.n).persist()
        drawn, rounds, wanted = [first.p], 0, max(OVERSAMPLING * k, LEAST_DRAWS)
        while k > 1 and (rounds < ROUNDS or len(drawn) < k):
            far = _with_nearest(keyed, names, [flat(p) for p in drawn]).withColumn("d", F.expr("if(d > 0 and d < double('infinity'), d, null)")).persist()
            whole = far.agg(F.sum("d")).first()[0]
            more = far.filter(unit(f"draw{rounds}") < F.col("d") * (wanted / whole)).select(*names, "own", "key").collect() if whole else []
            far.unpersist()
            if not whole:
                break
            more.sort(key=lambda p: (p.own is not None, *([p.own] if p.own is not None else []), *flat(p)))
            fresh: dict[tuple, object] = {}
            for p in more:
                fresh.setdefault(flat(p), p)
            drawn += fresh.values()
            rounds += 1
        points = np.array([flat(p) for p in drawn], float)
        if len(drawn) <= k:
            keyed.unpersist()
            return [tuple(p) for p in points.tolist()] + [tuple(points[0].tolist())] * (k - len(drawn))
        weights = np.zeros(len(points))
        for r in _with_nearest(keyed.select(*names), names, points.tolist()).groupBy("near").count().collect():
            weights[r["near"]] = r["count"]
        keyed.unpersist()
        return [tuple(p) for p in points[_weighted_seeds(points, weights, [p.key for p in drawn], k, self.seed)].tolist()]


def _with_nearest(points: DataFrame, names: Sequence[str], to: Sequence[Sequence[float]]) -> DataFrame:
    """`points` with `near`, the number of the nearest of `to` (the lowest of equals, 0 if a value is NaN), and `d`, its squared distance."""
    if len(to) * len(names) <= SEED_LITERALS and len(to[0]) == len(names) and not is_vector(points, names[0]):
        return points.withColumns({"near": nearest(names, to), "d": F.least(*(squared_distance(names, p) for p in to), F.lit(float("inf")))})
    fixed = np.array(to, float)
    nearest_to = NearestPoints(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.select(names))
            near = nearest_to(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(((x - fixed[near]) ** 2).sum(1))], names=[*batch.schema.names, "near", "d"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("d", T.DoubleType())]))


def _weighted_seeds(points: np.ndarray, weights: np.ndarray, keys: Sequence[str], k: int, seed: int) -> list[int]:
    """D^2 sampling of k weighted points as a race: the largest ln(u) / (weight * D^2) wins, with u hashed from key and step."""
    chosen, distance = [], np.ones(len(points))
    for step in range(k):
        u = np.array([(int(hashlib.md5(f"{seed}:seed{step}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52) for key in keys])
        mass = weights * distance
        some = mass > 0
        race = np.where(some, np.log(u) / np.where(some, mass, 1.0), -np.inf)
        chosen.append(int(np.argmax(race)) if some.any() else chosen[0])
        new = ((points - points[chosen[-1]]) ** 2).sum(1)
        distance = new if step == 0 else np.minimum(distance, new)
    return chosen
