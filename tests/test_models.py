"""Linear models, PCA, k-means and trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import gram as grams
from quillspark.operators.clustering import KMeans, KMeansModel
from quillspark.operators.decomposition import PCA
from quillspark.operators.linear import JITTER, LinearRegression, LogisticRegression, solve_spd
from quillspark.operators.metrics import accuracy, r2_score
from quillspark.operators.preprocessing import StandardScaler
from quillspark.operators.trees import DecisionTree, DecisionTreeModel, Node, RandomForest, RandomForestModel, bootstrap, multiplicities, poisson_steps
from quillspark.sources.features import from_columns, from_rows
from quillspark.streaming.apply import apply_models, stream_parquet, write_parquet

NAN = float("nan")
rng = np.random.default_rng(11)


def _frame(spark, x, y=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    return from_rows(spark, x if y is None else np.column_stack([x, y]), names + ([] if y is None else ["y"])), names


# Sums of products


@pytest.mark.parametrize("d", [3, 20])
def test_gram_and_moments(spark, d):
    x = rng.uniform(size=(200, d)) + 1e4
    df, names = _frame(spark, x)
    assert np.allclose(grams.gram(df, names), x.T @ x, rtol=1e-10)
    m = grams.moments(df, names)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.covariance, np.cov(x.T), atol=1e-6)
    arrays = df.select(F.array(*names).alias("v"))
    assert np.allclose(grams.moments(arrays, ["v"]).covariance, np.cov(x.T), atol=1e-6)


def test_covariance_of_one_row_is_zero(spark):
    df, names = _frame(spark, np.array([[1.0, 2.0]]))
    assert {r.value for r in grams.covariance_frame(df, names).collect()} == {0.0}


# Linear models


def test_least_squares_recovers_a_plane(spark):
    x = rng.uniform(0, 10, (1000, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 1.5 * x[:, 2] + 5
    df, names = _frame(spark, x, y)
    m = LinearRegression().fit(df, names, "y")
    assert m.weights == pytest.approx((3, -2, 1.5), abs=1e-3) and m.intercept == pytest.approx(5, abs=1e-2) and m.n_features == 3
    assert r2_score(m.transform(df), "y", "prediction") > 0.999


def test_ridge_shrinks_and_matches_the_formula(spark):
    x = rng.uniform(0, 5, (300, 2))
    y = 2 * x[:, 0] + x[:, 1] + 3
    df, names = _frame(spark, x, y)
    plain, ridge = LinearRegression().fit(df, names, "y"), LinearRegression(50.0).fit(df, names, "y")
    assert np.linalg.norm(ridge.weights) < np.linalg.norm(plain.weights)
    c, d = x - x.mean(0), y - y.mean()
    assert np.allclose(ridge.weights, np.linalg.solve(c.T @ c + 50 * np.eye(2), c.T @ d))
    bare = LinearRegression(2.0, fit_intercept=False).fit(df, names, "y")
    assert bare.intercept == 0.0 and np.allclose(bare.weights, np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ y))
    with pytest.raises(ValueError):
        LinearRegression(-1.0)


def test_singular_designs_are_solved(spark):
    x = np.column_stack([np.arange(50.0), 2 * np.arange(50.0)])
    df, names = _frame(spark, x, np.arange(50.0))
    m = LinearRegression().fit(df, names, "y")
    assert np.isfinite(m.weights).all() and r2_score(m.transform(df), "y", "prediction") > 0.999
    assert np.isfinite(solve_spd(np.zeros((2, 2)), np.ones(2))).all() and JITTER == 1e-6


def test_prediction_needs_its_columns(spark):
    df, names = _frame(spark, rng.uniform(size=(10, 2)), rng.uniform(size=10))
    with pytest.raises(Exception, match="f1|UNRESOLVED"):
        LinearRegression().fit(df, names, "y").transform(df.select("f0")).collect()


def _batch_gradient(x, y, rate, epochs, l2):
    w, b = np.zeros(x.shape[1]), 0.0
    for e in range(epochs):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        step = rate / (1 + 0.01 * e)
        w, b = w - step * ((off[:, None] * x).mean(0) + l2 * w), b - step * off.mean()
    return w, b


def test_logistic_batch_equals_plain_gradient_descent(spark):
    x = rng.uniform(-5, 5, (300, 2))
    y = (2 * x[:, 0] - 3 * x[:, 1] + 1 > 0).astype(float)
    df, names = _frame(spark, x, y)
    m = LogisticRegression(0.5, 15, 0.001).fit(df, names, "y")
    w, b = _batch_gradient(x, y, 0.5, 15, 0.001)
    assert np.allclose(m.weights, w) and m.bias == pytest.approx(b)
    out = m.transform(df, probability="p")
    assert accuracy(out, "y", "prediction") >= 0.9
    probe = m.transform(from_rows(spark, [[4, -4], [-4, 4], [NAN, 0]], names), probability="p").orderBy("row_id").collect()
    assert probe[0].p > 0.7 and probe[1].p < 0.3 and probe[2].prediction == 0.0


def test_logistic_sgd_is_sequential_in_one_partition(spark):
    x = rng.uniform(-2, 2, (60, 2))
    y = (x[:, 0] > 0).astype(float)
    df, names = _frame(spark, x, y)
    m = LogisticRegression(0.1, 3, 0.01, solver="sgd").fit(df.coalesce(1), names, "y", "row_id")
    w, b = np.zeros(2), 0.0
    for e in range(3):
        step = 0.1 / (1 + 0.01 * e)
        for row, t in zip(x, y, strict=True):
            off = 1 / (1 + np.exp(-(row @ w + b))) - t
            b -= step * off
            w = w - step * (off * row + 0.01 * w)
    assert np.allclose(m.weights, w) and m.bias == pytest.approx(b)
    with pytest.raises(ValueError):
        LogisticRegression(solver="sgd").fit(df, names, "y")


# PCA


def test_pca(spark):
    t = rng.uniform(0, 10, 500)
    x = np.column_stack([2 * t, -1.5 * t, rng.uniform(0, 0.5, 500), rng.uniform(0, 0.2, 500), 0.8 * t, rng.uniform(0, 0.1, 500)])
    df, names = _frame(spark, x)
    m = PCA(3).fit(df, names)
    assert list(m.explained_variance) == sorted(m.explained_variance, reverse=True)
    c = np.array(m.components)
    assert np.allclose(c @ c.T, np.eye(3), atol=1e-9) and all(row[np.argmax(np.abs(row))] > 0 for row in c)
    assert np.allclose(m.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])
    back = m.inverse(m.transform(df)).orderBy("row_id").toPandas()
    assert np.abs(back[[f"back_f{i}" for i in range(6)]].to_numpy() - x).max() < 0.6
    assert PCA(9).fit(df, names).n_components == 6
    arrays = PCA(3).fit(df.select("row_id", F.array(*names).alias("v")), ["v"])
    assert np.allclose(np.abs(arrays.components), np.abs(c), atol=1e-6)
    projected = arrays.transform(df.select("row_id", F.array(*names).alias("v"))).orderBy("row_id").toPandas()
    assert np.allclose(projected["pc0"], (x - x.mean(0)) @ np.array(arrays.components[0]), atol=1e-6)
    with pytest.raises(ValueError):
        PCA(0)


# k-means


def _blobs(n=100):
    return np.concatenate([rng.uniform(-1, 1, (n, 2)) + c for c in ((0, 0), (50, 50), (-50, 50))])


def test_kmeans_finds_blobs(spark):
    x = _blobs()
    df, names = _frame(spark, x)
    m = KMeans(3).fit(df, names)
    got = [r.cluster for r in m.transform(df).orderBy("row_id").collect()]
    assert all(len(set(got[i : i + 100])) == 1 for i in (0, 100, 200)) and len(set(got)) == 3
    assert m.centroid_norms_sq == pytest.approx([sum(v * v for v in c) for c in m.centroids]) and (m.k, m.dimensions) == (3, 2)


@pytest.mark.parametrize(("d", "k"), [(2, 5), (8, 10), (32, 17)])
def test_assignment_equals_a_scan_in_all_forms(spark, d, k):
    x = rng.uniform(0, 100, (300, d)) + 1e5
    df, names = _frame(spark, x)
    c = x[:k]
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    m = KMeansModel(tuple(names), tuple(map(tuple, c)))
    assert [r.cluster for r in m.transform(df).orderBy("row_id").collect()] == want.tolist()
    arrays = df.select("row_id", F.array(*names).alias("v"))
    assert [r.cluster for r in KMeansModel(("v",), m.centroids).transform(arrays).orderBy("row_id").collect()] == want.tolist()


def test_ties_nan_and_empty_clusters(spark):
    m = KMeansModel(("a",), ((0.0,), (2.0,), (2.0,)))
    rows = m.transform(from_columns(spark, {"a": [1.0, 2.0, NAN]})).orderBy("row_id").collect()
    assert [r.cluster for r in rows] == [0, 1, 0]
    df = from_columns(spark, {"a": [1.0, 1.0, 9.0]})
    start = [[1.0], [9.0], [1000.0]]
    assert KMeans(3, 1, 0.0, initial_centroids=start).fit(df, ["a"]).centroids[2] == (0.0,)
    assert KMeans(3, 1, 0.0, initial_centroids=start, empty="previous").fit(df, ["a"]).centroids[2] == (1000.0,)


@pytest.mark.parametrize("limit", [256, 1])
def test_drawn_seeds_cover_many_groups_in_few_jobs(spark, limit, monkeypatch):
    """A seed for each of forty groups, whatever form compares rows with points, in at most seven jobs with rows."""
    from quillspark.operators import clustering

    monkeypatch.setattr(clustering, "SEED_LITERALS", limit)
    centres = np.array([(i * 100.0, j * 100.0) for i in range(8) for j in range(5)])
    x = np.repeat(centres, 25, axis=0) + rng.uniform(-1, 1, (1000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    calls = []
    own = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: calls.append(1) or own(self))
    seeds = np.array(KMeans(40, 0).fit(df, ["a", "b"], "id").centroids)
    assert 3 < len(calls) <= 7
    near = ((seeds[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert len(seeds) == 40 and len(set(near.tolist())) >= 38


def test_seeds_of_odd_values(spark):
    rows = [(i, float(i % 3), 1.0) for i in range(50)] + [(None, NAN, 1.0), (60, float("inf"), 1.0), (None, 7.0, 2.0), (3, 7.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    seeds = KMeans(4, 0).fit(df, ["a", "b"], "id").centroids
    assert len(set(seeds)) == 4 and np.isfinite(seeds).all()
    few = KMeans(9, 0).fit(df.filter("id < 50 AND b = 1.0"), ["a", "b"], "id").centroids
    assert len(few) == 9 and len(set(few)) == 3
    plain = {KMeans(4, 0).fit(d, ["a", "b"]).centroids for d in (df.coalesce(1), df.repartition(7), df.orderBy("b"))}
    assert len(plain) == 1


def test_tolerance_is_on_the_squared_shift(spark):
    df = from_columns(spark, {"a": [0.0, 0.2]})
    assert KMeans(1, 50, 0.02, initial_centroids=[[0.0]]).fit(df, ["a"]).iterations == 1
    assert KMeans(1, 50, 0.005, initial_centroids=[[0.0]]).fit(df, ["a"]).iterations == 2


def test_fewer_rows_than_clusters(spark):
    assert KMeans(5).fit(from_columns(spark, {"a": [1.0, 2.0]}), ["a"]).k == 2
    assert KMeans(2).fit(from_columns(spark, {"a": [1.0, 1.0, 1.0]}), ["a"]).k == 2
    with pytest.raises(ValueError):
        KMeans(2).fit(spark.createDataFrame([], "a double"), ["a"])
    with pytest.raises(ValueError):
        KMeans(0)


# Trees


def _gini(y):
    p = y.sum() / len(y)
    return 1.0 - p * p - (1.0 - p) * (1.0 - p)


def _brute_split(values, y):
    n, best = len(y), None
    for f in range(values.shape[1]):
        for t in values[:: max(1, n // 32), f]:
            left = values[:, f] <= t
            if left.any() and not left.all():
                gain = _gini(y) - (left.sum() / n) * _gini(y[left]) - ((~left).sum() / n) * _gini(y[~left])
                if gain > 0 and (best is None or gain > best[2]):
                    best = (f, t, gain)
    return best


def _brute_tree(x, y, depth, at=0):
    pos = y.sum()
    leaf = {at: 1.0 if len(y) and 2 * pos >= len(y) else 0.0}
    if not depth or len(y) < 2 or pos in (0, len(y)):
        return {}, leaf
    found = _brute_split(x, y)
    if not found or found[2] <= 1e-6:
        return {}, leaf
    low = x[:, found[0]] <= found[1]
    a, b = _brute_tree(x[low], y[low], depth - 1, 2 * at + 1), _brute_tree(x[~low], y[~low], depth - 1, 2 * at + 2)
    return {at: found[:2], **a[0], **b[0]}, {**leaf, **a[1], **b[1]}


def _heap(nodes, at=0, heap=0):
    node = nodes[at]
    return {} if node.is_leaf else {heap: (node.feature, node.threshold), **_heap(nodes, node.left, 2 * heap + 1), **_heap(nodes, node.right, 2 * heap + 2)}


@pytest.mark.parametrize("n", [20, 63, 200, 600])
def test_tree_equals_a_recursive_one(spark, n):
    x = np.round(rng.uniform(0, 10, (n, 3)), 1)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3)).astype(float)
    df, names = _frame(spark, x, y)
    m = DecisionTree(4).fit(df.repartition(3), names, "y", "row_id")
    assert _heap(m.nodes) == _brute_tree(x, y.astype(int), 4)[0]


@pytest.mark.parametrize("bounds", [{"MOST_ROWS": 8}, {"MOST_CELLS": 1, "MOST_VALUES": 1}, {"KEPT_BYTES": 0}, {"FEATURE_CELLS": 4, "ID_CELLS": 32}])
def test_tree_does_not_depend_on_the_bounds_of_its_work(spark, bounds, monkeypatch):
    """Continuous values, skewed ids, NaN: fetched after finer counts, in portions, without kept histograms, or from few cells."""
    from quillspark.operators import trees

    for name, value in bounds.items():
        monkeypatch.setattr(trees, name, value)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(900, 2))
    x[draw.random(900) < 0.05, 1] = NAN
    y = (x[:, 0] * np.nan_to_num(x[:, 1]) > 0).astype(int)
    ids = np.sort((draw.pareto(0.4, 900) * 1000).astype(np.int64) * 1000 + np.arange(900))
    df = spark.createDataFrame([(int(i), float(a), float(b), int(c)) for i, (a, b), c in zip(ids, x, y, strict=True)], "id long, a double, b double, y int")
    assert _heap(DecisionTree(4).fit(df, ["a", "b"], "y", "id").nodes) == _brute_tree(x, y, 4)[0]


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "double", "int"])
def test_tree_takes_ids_of_all_kinds(spark, kind):
    x = np.round(rng.uniform(0, 10, (300, 2)), 1)
    y = (x[:, 0] > x[:, 1]).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int")
    own = {"string": F.format_string("%05d", "id"), "timestamp": F.timestamp_micros(F.col("id").cast("long") * 7), "date": F.date_from_unix_date("id"), "double": F.col("id") / 7, "int": F.col("id")}[kind]
    m = DecisionTree(3).fit(df.withColumn("id", own), ["a", "b"], "y", "id")
    assert _heap(m.nodes) == _brute_tree(x, y, 3)[0]


def test_rows_of_one_id_go_by_a_hash_of_their_values(spark, monkeypatch):
    """A third of the rows have one id, some none: any layout gives the same tree, and no cell is fetched whole."""
    from quillspark.operators import trees

    draw = np.random.default_rng(9)
    rows = [(None if i % 11 == 0 else 5 if i % 3 == 0 else i, float(draw.integers(200)), int(draw.integers(2))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    whole = DecisionTree(3).fit(df, ["a"], "y", "id").nodes
    assert DecisionTree(3).fit(df.orderBy("a").coalesce(1), ["a"], "y", "id").nodes == whole
    monkeypatch.setattr(trees, "MOST_ROWS", 100)
    assert DecisionTree(3).fit(df.repartition(3, "y"), ["a"], "y", "id").nodes == whole


def test_fit_runs_no_python_and_no_window(spark):
    from quillspark.operators import trees

    df, names = _frame(spark, rng.uniform(size=(50, 2)), rng.integers(0, 2, 50).astype(float))
    table = trees._Table(trees._keyed(trees._samples(df, names, "y", "row_id")[0]), 2, F.array(F.lit(1)), 1)
    plan = table.routed(trees._Nodes(1), 2, [0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    table.base.unpersist()


def test_tree_thresholds_and_order_of_nodes(spark):
    x = rng.uniform(0, 10, (200, 2))
    df, names = _frame(spark, x, (x[:, 0] > 5).astype(float))
    m = DecisionTree(4).fit(df, names, "y", "row_id")
    assert accuracy(m.transform(df), "y", "prediction") >= 0.98
    got = m.transform(from_rows(spark, [[2, 8], [8, 2], [NAN, 2]], names)).orderBy("row_id").collect()
    assert [r.prediction for r in got] == [0.0, 1.0, 1.0]
    assert not m.nodes[0].is_leaf and m.nodes[0].left == 1 and m.frame(spark).count() == len(m.nodes)
    deep = DecisionTree(12).fit(df, names, "y", "row_id")
    assert [r.prediction for r in deep.transform(df).orderBy("row_id").collect()] == [float(v > 5) for v in x[:, 0]]


def test_exact_index_split_and_degenerate_labels(spark):
    x = np.column_stack([np.arange(20.0), np.full(20, 10.0)])
    df, names = _frame(spark, x, (np.arange(20) >= 10).astype(float))
    assert accuracy(DecisionTree(3).fit(df, names, "y", "row_id").transform(df), "y", "prediction") == 1.0
    zero, names = _frame(spark, np.zeros((50, 2)), np.zeros(50))
    assert DecisionTree().fit(zero, names, "y", "row_id").nodes == (Node.leaf(0.0),)
    same, names = _frame(spark, np.zeros((50, 2)), (np.arange(50) < 30).astype(float))
    assert DecisionTree().fit(same, names, "y", "row_id").nodes == (Node.leaf(1.0),)
    tie, names = _frame(spark, np.zeros((4, 1)), np.array([0.0, 1, 0, 1]))
    assert DecisionTree().fit(tie, names, "y", "row_id").nodes == (Node.leaf(1.0),)
    nan_label, names = _frame(spark, np.zeros((4, 1)), np.array([NAN, NAN, NAN, 1]))
    assert DecisionTree().fit(nan_label, names, "y", "row_id").nodes == (Node.leaf(0.0),)


def test_min_samples_and_feature_subset(spark):
    x = rng.uniform(0, 100, (500, 5))
    df, _ = _frame(spark, x, ((x[:, 2] > 50) & (x[:, 4] < 70)).astype(float))
    m = DecisionTree(6, 4).fit(df, ["f2", "f4"], "y", "row_id")
    assert accuracy(m.transform(df), "y", "prediction") >= 0.9
    assert len(DecisionTree(6, 501).fit(df, ["f2"], "y", "row_id").nodes) == 1


def test_forest(spark):
    x = rng.uniform(0, 10, (500, 4))
    df, names = _frame(spark, x, (x[:, 0] + x[:, 1] > 10).astype(float))
    m = RandomForest(7, 5, subsample_ratio=0.8).fit(df, names, "y", "row_id")
    out = m.transform(df)
    assert m.num_trees == 7 and accuracy(out, "y", "prediction") >= 0.9
    p = out.agg(F.min("probability"), F.max("probability")).first()
    assert 0 <= p[0] <= p[1] <= 1
    assert api.fit_random_forest(df, "Y", ["F0", "F1"], "row_id", num_trees=2, max_depth=2).num_trees == 2
    assert RandomForest(0, subsample_ratio=0.0).num_trees == 1 and RandomForest(subsample_ratio=0.0).subsample_ratio == 0.1


@pytest.mark.parametrize("exact", [False, True])
def test_forest_equals_trees_of_the_rows_drawn(spark, exact):
    x = np.round(rng.uniform(0, 10, (400, 2)), 2)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3)).astype(int)
    df, names = _frame(spark, x, y.astype(float))
    m = RandomForest(3, 3, exact=exact).fit(df, names, "y", "row_id")
    if exact:
        draws = bootstrap(spark, 3, 400, 320).groupBy("pos", "tree").count().collect()
        times = {(r.tree, r.pos): r["count"] for r in draws}
    else:
        times = {(t, r.row_id): k for r in df.select("row_id", multiplicities(F.col("row_id"), 3, 0.8).alias("w")).collect() for t, k in enumerate(r.w)}
    for t, nodes in enumerate(m.trees):
        drawn = np.repeat(np.arange(400), [times.get((t, i), 0) for i in range(400)])
        assert _heap(nodes) == _brute_tree(x[drawn], y[drawn], 3)[0]


def test_multiplicities_are_poisson(spark):
    draws = spark.range(20_000).select(F.explode(multiplicities(F.col("id"), 2, 0.8)).alias("w"))
    share = {r.w: r["count"] / 40_000 for r in draws.groupBy("w").count().collect()}
    assert share[0] == pytest.approx(np.exp(-0.8), abs=0.01) and share[1] == pytest.approx(0.8 * np.exp(-0.8), abs=0.01) and share[3] == pytest.approx(0.8**3 / 6 * np.exp(-0.8), abs=0.01)
    assert poisson_steps(0.8) == sorted(set(poisson_steps(0.8)))


def test_forest_without_rows(spark):
    for exact in (False, True):
        with pytest.raises(ValueError, match="no rows"):
            RandomForest(2, exact=exact).fit(spark.createDataFrame([], "id long, a double, y double"), ["a"], "y", "id")


def test_bootstrap_draws_with_replacement(spark):
    rows = bootstrap(spark, 2, 50, 40).collect()
    assert len(rows) == 80 and all(0 <= r.pos < 50 for r in rows)
    assert len({r.pos for r in rows if r.tree == 0}) < 40 and [r.pos for r in rows if r.tree == 0] != [r.pos for r in rows if r.tree == 1]


def test_big_forest_is_scored_in_batches_alike(spark):
    x = rng.uniform(0, 10, (80, 2))
    df, names = _frame(spark, x, (x[:, 0] > 4).astype(float))
    m = RandomForest(2, 3).fit(df, names, "y", "row_id")
    many = type(m)(m.features, m.trees * 60, m.max_depth)
    assert [r.probability for r in many.transform(df).orderBy("row_id").collect()] == pytest.approx([r.probability for r in m.transform(df).orderBy("row_id").collect()])


def test_shared_interfaces(spark):
    from quillspark.operators.base import Estimator, Predictor, Transformer

    assert all(isinstance(e, Estimator) for e in (KMeans(2), PCA(1), LinearRegression(), LogisticRegression(), DecisionTree(), RandomForest()))
    df, names = _frame(spark, rng.uniform(size=(20, 2)), rng.integers(0, 2, 20).astype(float))
    assert isinstance(LinearRegression().fit(df, names, "y"), Predictor) and isinstance(KMeans(2).fit(df, names), Predictor)
    assert isinstance(RandomForest(1, 1).fit(df, names, "y", "row_id"), Transformer)


# Array columns


def test_fits_on_an_array_column_equal_those_on_columns(spark):
    x = np.round(rng.uniform(-3, 5, (300, 6)), 2)
    y = (x[:, 1] - x[:, 4] > 0).astype(float)
    df, names = _frame(spark, x, y)
    both = df.withColumn("v", F.array(*names)).repartition(3).persist()
    a, b = api.fit_standard_scaler(both, ["V"]), api.fit_standard_scaler(both, names)
    assert np.allclose(a.shifts, b.shifts) and np.allclose(a.scales, b.scales)
    scaled = a.transform(both).select("v", "row_id").orderBy("row_id").collect()
    assert np.allclose([r.v for r in scaled], (x - x.mean(0)) / x.std(0))
    a, b = api.fit_minmax_scaler(both, ["v"]), api.fit_minmax_scaler(both, names)
    assert np.allclose(a.shifts, b.shifts) and np.allclose(a.scales, b.scales)
    for alpha, intercept in ((0.0, True), (3.0, False)):
        a, b = (LinearRegression(alpha, intercept).fit(both, f, "y") for f in (["v"], names))
        assert np.allclose(a.weights, b.weights) and a.intercept == pytest.approx(b.intercept) and a.n_features == 6
        assert np.allclose([r.prediction for r in a.transform(both).orderBy("row_id").collect()], [r.prediction for r in b.transform(both).orderBy("row_id").collect()])
    a, b = (LogisticRegression(0.3, 5).fit(both, f, "y") for f in (["v"], names))
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)
    assert a.transform(both, "p1", "p").join(b.transform(both, "q1", "q"), "row_id").filter("p1 <> q1 OR abs(p - q) > 1e-9").count() == 0
    start = x[:4]
    a, b = (KMeans(4, 3, 0.0, initial_centroids=start).fit(both, f) for f in (["v"], names))
    assert np.allclose(a.centroids, b.centroids) and a.transform(both).join(b.transform(both, "other"), "row_id").filter("cluster <> other").count() == 0
    assert KMeans(5, 0).fit(both, ["v"], "row_id").centroids == KMeans(5, 0).fit(both, names, "row_id").centroids
    a, b = (DecisionTree(3).fit(both, f, "y", "row_id") for f in (["v"], names))
    assert a.nodes == b.nodes and a.transform(both).join(b.transform(both, "other"), "row_id").filter("prediction <> other").count() == 0
    a, b = (RandomForest(3, 2).fit(both, f, "y", "row_id") for f in (["v"], names))
    assert a.trees == b.trees
    many = type(a)(a.features, a.trees * 60, a.max_depth, True)
    assert [r.probability for r in many.transform(both).orderBy("row_id").collect()] == pytest.approx([r.probability for r in b.transform(both).orderBy("row_id").collect()])
    both.unpersist()


@pytest.mark.parametrize("shape", [(400, 64), (60, 300)])
def test_krylov_components_equal_exact_ones(spark, shape):
    """More rows than features, and fewer: then the covariance has not full rank."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=shape) * np.linspace(3, 0.5, shape[1]) + 5
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>").repartition(4)
    a, b = PCA(6, "krylov").fit(df, ["v"]), PCA(6, "exact").fit(df, ["v"])
    assert np.allclose(a.explained_variance, b.explained_variance, rtol=1e-9) and np.allclose(a.explained_variance_ratio, b.explained_variance_ratio, rtol=1e-9)
    assert np.allclose(np.abs((np.array(a.components) * np.array(b.components)).sum(1)), 1, atol=1e-7) and np.allclose(a.mean, b.mean)
    assert PCA(9, "krylov").fit(df.select(F.slice("v", 1, 4).alias("v")), ["v"]).n_components == 4
    flat = PCA(2, "krylov").fit(df.select(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("v")), ["v"])
    assert flat.explained_variance_ratio == (0.0, 0.0)
    with pytest.raises(ValueError):
        PCA(2, "krylov").fit(df.limit(0), ["v"])


def test_five_thousand_columns(spark, monkeypatch):
    """Only vectors of that length are held, no square of it."""
    from quillspark.operators import decomposition, linear

    draw = np.random.default_rng(2)
    x = draw.normal(size=(80, 3)) @ draw.normal(size=(3, 5000)) + 0.001 * draw.normal(size=(80, 5000))
    df = spark.createDataFrame([(list(map(float, r)), float(r[0] - r[1])) for r in x], "v array<double>, y double").repartition(3)
    for module in (decomposition, linear):
        monkeypatch.setattr(module, "moments", lambda *a: pytest.fail("the square was summed"))
    m = PCA(3).fit(df, ["v"])
    assert sum(m.explained_variance_ratio) > 0.99 and m.n_features == 5000
    fit = LinearRegression(1e-3).fit(df, ["v"], "y")
    got = fit.transform(df).select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert got < 1e-2 and fit.n_features == 5000


@pytest.mark.parametrize(("alpha", "intercept"), [(0.0, True), (5.0, True), (0.5, False)])
def test_gradients_agree_with_the_normal_equations(spark, alpha, intercept):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 30)) * 10.0 ** draw.integers(-2, 3, 30) + 2
    y = x @ draw.normal(size=30) + 0.1 * draw.normal(size=500)
    df, names = _frame(spark, x, y)
    arrays = df.select(F.array(*names).alias("v"), "y")
    want = LinearRegression(alpha, intercept, "normal").fit(df, names, "y")
    for rows, features in ((df, names), (arrays, ["v"])):
        got = LinearRegression(alpha, intercept, "gradients").fit(rows, features, "y")
        assert np.allclose(got.weights, want.weights, rtol=1e-8, atol=1e-8) and got.intercept == pytest.approx(want.intercept, abs=1e-6)
    with pytest.raises(ValueError):
        LinearRegression(solver="other")


def test_odd_array_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [3.0, None], 0.0)], "id long, v array<double>, y double")
    for fit in (lambda d: StandardScaler().fit(d, ["v"]), lambda d: KMeans(2).fit(d, ["v"]), lambda d: LinearRegression().fit(d, ["v"], "y")):
        with pytest.raises(Exception, match="null in column v"):
            fit(rows)
        with pytest.raises(Exception, match="different lengths"):
            fit(spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [3.0], 0.0), (3, [3.0, 4.0, 5.0], 0.0)], rows.schema).coalesce(1))
        with pytest.raises(ValueError):
            fit(rows.limit(0))
    with pytest.raises(TypeError):
        KMeans(2).fit(rows, ["v", "y"])
    empty = KMeans(2, 1, 0.0, initial_centroids=[[0.0, 0.0], [9.0, 9.0]], empty="previous").fit(rows.filter("id = 1"), ["v"])
    assert empty.centroids == ((1.0, 2.0), (9.0, 9.0))
    constant = StandardScaler().fit(spark.createDataFrame([([5.0, float(i)],) for i in range(4)], "v array<float>"), ["v"])
    assert constant.scales[0] == 1.0 and constant.shifts == (5.0, 1.5)


# Streams


def test_models_on_a_stream(spark, tmp_path):
    x = rng.uniform(0, 10, (30, 2))
    df, names = _frame(spark, x, (x[:, 0] > 5).astype(float))
    df.write.parquet(str(tmp_path / "in"))
    scaler = api.fit_standard_scaler(df, names)
    tree = api.fit_decision_tree(scaler.transform(df), "y", names, "row_id", max_depth=2)
    stream = apply_models(stream_parquet(spark, str(tmp_path / "in"), df.schema), scaler, tree)
    query = write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 30 and accuracy(got, "y", "prediction") >= 0.9


def test_names_with_dots_and_names_of_our_own(spark):
    rows = [(float(i), float(i % 7), float(i > 20), i) for i in range(40)]
    df = spark.createDataFrame(rows, "`a.b` double, _off double, `cluster` double, id long")
    names = ["a.b", "_off"]
    assert LinearRegression().fit(df, names, "cluster").transform(df).count() == 40
    assert LogisticRegression(epochs=2).fit(df, names, "cluster").transform(df).count() == 40
    assert KMeans(2, 3).fit(df, ["a.b", "cluster"], "id").transform(df, "at").select("at").distinct().count() == 2
    assert PCA(1).fit(df, names).transform(df).count() == 40
    assert DecisionTree(2).fit(df, names, "cluster", "id").transform(df).filter("prediction = cluster").count() == 40


def test_drawn_seeds_do_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(i, float(i * i % 101), float(i % 13)) for i in range(300)], "id long, x double, y double")
    fits = {KMeans(4, 1).fit(d, ["x", "y"], "id").centroids for d in (df.coalesce(1), df.repartition(5), df.orderBy("y"))}
    assert len({tuple(tuple(round(v, 9) for v in c) for c in f) for f in fits}) == 1


def test_positions_of_other_ids_nulls_and_ties(spark):
    from quillspark.operators.trees import positions

    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "b", "zz", "y"]], "k string")
    numbered, n = positions(df, "k")
    got = [r.k for r in numbered.orderBy("pos").collect()]
    assert n == 7 and got == [None, "a", "b", "b", "c", "y", "zz"] and sorted(r.pos for r in numbered.collect()) == list(range(7))
    assert positions(df.limit(0), "k")[1] == 0
    numbers = spark.createDataFrame([(float(i * 7919 % 1009), i) for i in range(1009)], "k double, i long")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert [r.k for r in positions(numbers, "k")[0].orderBy("pos").collect()] == [float(i) for i in range(1009)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("n", "k", "d"), [(3000, 1000, 8), (500, 130, 2), (400, 300, 40)])
def test_points_in_groups_give_the_same_nearest(n, k, d):
    """Clustered and spread points, doubled points, far offsets, values that are not finite."""
    from quillspark.operators.clustering import NearestPoints

    draw = np.random.default_rng(k)
    points = draw.normal(size=(k, d)) * 3 + draw.integers(0, 4, (k, 1)) * 25 + 1e3
    points[k // 2 : k // 2 + 20] = points[:20]
    x = np.concatenate([points[draw.integers(0, k, n)] + draw.normal(size=(n, d)), points[:50], draw.normal(size=(50, d)) * 500])
    x[5, 0], x[6, 1], x[7, 0] = NAN, float("inf"), -float("inf")
    got = NearestPoints(points)(x)
    with np.errstate(invalid="ignore"):
        want = [0 if not np.isfinite(r).all() else int(np.argmin(((r - points) ** 2).sum(1))) for r in x]
    assert got.tolist() == want
    assert NearestPoints(points)(x[:0]).tolist() == []


def test_nearest_points_with_ties_and_nan():
    from quillspark.operators.clustering import nearest_points

    rng = np.random.default_rng(0)
    x, points = rng.normal(0, 1, (500, 16)) + 1000, rng.normal(0, 1, (9, 16)) + 1000
    points[4] = points[2]
    x[3, 5] = np.nan
    want = [0 if np.isnan(r).any() else int(np.argmin(((r - points) ** 2).sum(1))) for r in x]
    assert nearest_points(x, points).tolist() == want


def test_forests_of_any_size_are_columns_too(spark):
    """The walk in SQL functions gives what Arrow batches give, and what the nodes say; nulls and NaN go right; no Python in the plan."""
    rng = np.random.default_rng(5)

    def grown(depth):
        nodes = []

        def add(d):
            at = len(nodes)
            nodes.append(None)
            if d == 0 or rng.random() < 0.15:
                nodes[at] = Node.leaf(float(rng.integers(2)))
            else:
                feature, cut = int(rng.integers(3)), float(rng.normal())
                left, right = add(d - 1), add(d - 1)
                nodes[at] = Node.branch(feature, cut, left, right)
            return at

        add(depth)
        return tuple(nodes)

    trees = (*(grown(k % 10) for k in range(30)), grown(11))
    values = [[float(v) for v in r] for r in rng.normal(size=(200, 3))] + [[None, 1.0, -1.0], [float("nan"), 0.0, 0.0], [0.1, None, None], [1e308, -1e308, float("inf")]]
    df = spark.createDataFrame([(i, *r, r) for i, r in enumerate(values)], "i long, q double, x double, v double, w array<double>").withColumnRenamed("q", "a.b")
    wide = RandomForestModel(("a.b", "x", "v"), trees, 11)
    assert sum(map(len, trees)) > 256
    one, many = df.withColumn("p", wide.probability()), wide.transform(df)
    assert "Python" not in one._jdf.queryExecution().executedPlan().toString() and "mapInArrow" not in one._jdf.queryExecution().toString()
    got, want = ({r.i: r[c] for r in t.collect()} for t, c in ((one, "p"), (many, "probability")))
    assert got == pytest.approx(want, abs=1e-12) and len(set(want.values())) > 5
    array = RandomForestModel(("w",), trees, 11, vector=True)
    assert {r.i: r.p for r in df.select("i", array.probability().alias("p")).collect()} == pytest.approx(want, abs=1e-12)
    deep = DecisionTreeModel(("a.b", "x", "v"), trees[-1], 11, 2)
    assert {r.i: r.p for r in df.select("i", deep.expr().alias("p")).collect()} == {r.i: r.prediction for r in deep.transform(df).collect()}
    points = KMeansModel(("a.b", "x"), tuple((float(k), -float(k)) for k in range(300)))
    assert points.transform(df).columns == [*df.columns, "cluster"]
    #: Nulls count as NaN; the squares of the last row overflow, so all points are as far from it.
    assert [r.cluster for r in points.transform(df).orderBy("i").collect()][200:] == [0] * 4
