"""Queries over the library operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import api
from quillspark.functions import expr
from quillspark.operators.clustering import KMeans, KMeansModel
from quillspark.operators.decomposition import PCA
from quillspark.operators.gram import covariance_frame, gram_frame, moments
from quillspark.operators.gram import gram as gram_matrix
from quillspark.operators.histogram import build_histogram, discretize
from quillspark.operators.linear import LinearRegression, LogisticRegression, project
from quillspark.operators.metrics import accuracy_frame, mse_frame, r2_frame
from quillspark.operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler, category_order, minmax_params, standard_params
from quillspark.operators.trees import DecisionTree, DecisionTreeModel, Node, RandomForestModel, bootstrap, gini_candidates, multiplicities, poisson_steps
from quillspark.plans import sql
from quillspark.sources.features import column, from_columns, from_rows, read_features, row, to_features, to_matrix, value, with_column

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, oracle)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _FOUND.items() if text}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names})


# Ingest and preprocessing

SCALED = ("l_quantity", "l_extendedprice", "l_discount")


@_query("SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem")
def features_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_features(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@_query("SELECT CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem")
def features_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column(_read(spark, sf_dir, "lineitem"), "L_QUANTITY").toDF("quantity")


@_query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS l_quantity FROM lineitem")
def features_with_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return with_column(rows, "L_Quantity", F.col("l_quantity") * 2 + 1)


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey = 7")
def features_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 7)


@_query("SELECT CAST(7 AS BIGINT) AS c_custkey, (SELECT c_acctbal FROM customer WHERE c_custkey = 7) AS c_acctbal")
def features_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(7, value(_read(spark, sf_dir, "customer"), "c_custkey", 7, "c_acctbal"))], "c_custkey long, c_acctbal double")


_SUPPLIERS = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier"


@_query(_SUPPLIERS)
def features_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["s_nationkey", "s_acctbal"]
    return from_rows(spark, to_matrix(_read(spark, sf_dir, "supplier"), names, "s_suppkey"), names)


@_query(_SUPPLIERS)
def features_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["s_nationkey", "s_acctbal"]
    matrix = to_matrix(_read(spark, sf_dir, "supplier"), names, "s_suppkey")
    return from_columns(spark, {c: matrix[:, k].tolist() for k, c in enumerate(names)})


@_query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(CASE WHEN stddev_pop({c}) <= 1e-8 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS {c}_std" for c in SCALED) + " FROM lineitem")
def std_scaler_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = standard_params(_read(spark, sf_dir, "lineitem"), SCALED)
    return _rounded(out, 6, *out.columns)


@_query(
    "WITH p AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) <= 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s" for c in SCALED) + " FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((l.{c} - p.{c}_m) / p.{c}_s, 4) + 0.0 AS {c}" for c in SCALED) + " FROM lineitem l, p"
)
def std_scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    return _rounded(StandardScaler().fit(rows, SCALED).transform(rows), 4, *SCALED)


@_query("SELECT c_custkey, CAST(0.0 AS DOUBLE) AS level FROM customer")
def std_scaler_constant_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.lit(7.5).alias("level"))
    return StandardScaler().fit(rows, ["level"]).transform(rows)


@_query("SELECT " + ", ".join(f"min({c}) AS {c}_min, CASE WHEN max({c}) - min({c}) <= 1e-8 THEN 1.0 ELSE max({c}) - min({c}) END AS {c}_range" for c in SCALED) + " FROM lineitem")
def minmax_params_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_params(_read(spark, sf_dir, "lineitem"), SCALED)


@_query("WITH p AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) + 0.0 AS c_acctbal FROM customer, p")
def minmax_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _rounded(MinMaxScaler().fit(rows, ["c_acctbal"]).transform(rows), 6, "c_acctbal")


@_query("WITH p AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) + 0.0 AS balance FROM customer, p")
def minmax_unclamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = MinMaxScaler().fit(_read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance")), ["balance"])
    return _rounded(fitted.transform(_read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))), 6, "balance")


@_query("SELECT s_suppkey, CAST(0.0 AS DOUBLE) AS level FROM supplier")
def minmax_constant_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.lit(3).alias("level"))
    return MinMaxScaler().fit(rows, ["level"]).transform(rows)


@_query("SELECT CAST(p_size AS INTEGER) AS category, min(p_partkey) AS first_id FROM part GROUP BY p_size")
def onehot_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_order(_read(spark, sf_dir, "part"), "p_size", "p_partkey")


_ONEHOT = "WITH o AS (SELECT n_regionkey AS c, row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS i FROM nation {where} GROUP BY n_regionkey) SELECT n_nationkey, {cells} FROM nation n LEFT JOIN o ON o.c = n.n_regionkey"


@_query(_ONEHOT.format(where="", cells=", ".join(f"CASE WHEN o.i = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r{i}" for i in range(5))))
def onehot_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return OneHotEncoder().fit(rows, "n_regionkey", "n_nationkey").transform(rows, "r").drop("n_regionkey")


@_query(_ONEHOT.format(where="WHERE n_regionkey < 3", cells=", ".join(f"CASE WHEN o.i = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r{i}" for i in range(3))))
def onehot_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return OneHotEncoder().fit(rows.filter("n_regionkey < 3"), "n_regionkey", "n_nationkey").transform(rows, "r").drop("n_regionkey")


# Metrics


@_query("SELECT avg(CASE WHEN round_even(l_quantity / 2, 0) = round_even(l_quantity / 2 + l_discount * 5, 0) THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem")
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 2).alias("a"), (F.col("l_quantity") / 2 + F.col("l_discount") * 5).alias("p"))
    return accuracy_frame(rows, "a", "p")


_GUESS = "l_quantity * 1500.0"


@_query(f"SELECT round(avg((l_extendedprice - {_GUESS}) * (l_extendedprice - {_GUESS})) / 1e6, 6) AS mse FROM lineitem")
def metric_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), F.expr(_GUESS).cast("double").alias("p"))
    return mse_frame(rows, "a", "p").select(F.round(F.col("mse") / 1e6, 6).alias("mse"))


@_query(f"SELECT round(1 - sum((l_extendedprice - {_GUESS}) * (l_extendedprice - {_GUESS})) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def metric_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), F.expr(_GUESS).cast("double").alias("p"))
    return _rounded(r2_frame(rows, "a", "p"), 6, "r2")


@_query("SELECT 1.0::DOUBLE AS r2")
def metric_r2_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r2_frame(_read(spark, sf_dir, "lineitem").select(F.lit(4.0).alias("a"), F.col("l_quantity").alias("p")), "a", "p")


# Bins and histograms

CUTS = (5.0, 10.0, 25.0, 50.0, 50.5, 100.0, 250.0)


@_query("SELECT event_id, CAST(" + " + ".join(f"CASE WHEN value > {c} THEN 1 ELSE 0 END" for c in CUTS) + " AS INTEGER) AS bin FROM events")
def discretize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discretize(_read(spark, sf_dir, "events").select("event_id", "value"), "value", CUTS).select("event_id", "bin")


_HISTOGRAM = "WITH h AS (SELECT event_id % 200 AS bin, sum(value) AS s, count(*) AS n FROM events GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS bin, round(coalesce(s, 0), 4) AS grad_sum{n} FROM range(256) r LEFT JOIN h ON h.bin = r.range"


def _binned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select((F.col("event_id") % 200).cast("int").alias("bin"), "value")


@_query(_HISTOGRAM.format(n=""))
def histogram_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_histogram(_binned_events(spark, sf_dir), "bin", "value"), 4, "grad_sum")


@_query(_HISTOGRAM.format(n=", CAST(coalesce(n, 0) AS BIGINT) AS n"))
def histogram_grad_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_histogram(_binned_events(spark, sf_dir), "bin", "value", counts=True), 4, "grad_sum")


# Vectors

_PAIRS = "SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@_query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(a[i] + b[i], 6) + 0.0 AS value FROM ({_PAIRS}), range(1, 65) r(i)")
def vector_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_pairs(spark, sf_dir).select("vec_id", F.posexplode(expr.array_add(F.col("a"), F.col("b"))).alias("i", "value"))
    return _rounded(rows, 6, "value")


@_query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(a[i] * 3.0 + b[i], 6) + 0.0 AS value FROM ({_PAIRS}), range(1, 65) r(i)")
def vector_fma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_pairs(spark, sf_dir).select("vec_id", F.posexplode(expr.array_fma(F.col("a"), 3.0, F.col("b"))).alias("i", "value"))
    return _rounded(rows, 6, "value")


@_query(f"SELECT vec_id, round(list_inner_product(a, b), 6) + 0.0 AS value FROM ({_PAIRS})")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_vector_pairs(spark, sf_dir).select("vec_id", expr.array_dot(F.col("a"), F.col("b")).alias("value")), 6, "value")


@_query(f"SELECT vec_id, round(list_distance(a, b) * list_distance(a, b), 6) + 0.0 AS value FROM ({_PAIRS})")
def squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_vector_pairs(spark, sf_dir).select("vec_id", expr.array_squared_distance(F.col("a"), F.col("b")).alias("value")), 6, "value")


@_query("SELECT event_id, round(CASE WHEN value - 50 > 20 THEN 1.0 WHEN value - 50 < -20 THEN 0.0 ELSE 1.0 / (1.0 + exp(-(value - 50))) END, 6) AS p FROM events")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_read(spark, sf_dir, "events").select("event_id", expr.sigmoid(F.col("value") - 50.0).alias("p")), 6, "p")


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity * 0.5 + l_discount * -2.0 + l_tax * 4.0, 4) + 0.0 AS y0, round(l_quantity * 1.25 + l_discount * 8.0 + l_tax * -0.5, 4) + 0.0 AS y1 FROM lineitem")
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    out = project(rows, ["l_quantity", "l_discount", "l_tax"], [[0.5, 1.25], [-2.0, 8.0], [4.0, -0.5]])
    return _rounded(out.select("l_orderkey", "l_linenumber", "y0", "y1"), 4, "y0", "y1")


# Sums of products

_THREE = ("l_quantity", "l_discount", "l_tax")


def _cells(value: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round({value.format(a=a, b=b)}, 5) AS value FROM lineitem" for i, a in enumerate(_THREE) for j, b in enumerate(_THREE))


@_query(_cells("sum({a} * {b}) / count(*)"))
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(*_THREE)
    n = rows.count()
    return gram_frame(rows, _THREE).select("i", "j", F.round(F.col("value") / n, 5).alias("value"))


@_query(_cells("covar_samp({a}, {b})").replace("round(covar_samp", "0.0 + round(covar_samp"))
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(covariance_frame(_read(spark, sf_dir, "lineitem").select(*_THREE), _THREE), 5, "value")


_FIRST = "(SELECT {0} AS category, row_number() OVER (ORDER BY min(l_orderkey * 8 + l_linenumber), {0}) - 1 AS place FROM lineitem WHERE {0} IS NOT NULL GROUP BY {0})"


@_query(f"SELECT l_orderkey, l_linenumber, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS size, place, 1.0::DOUBLE AS value FROM lineitem JOIN {_FIRST.format('l_partkey')} ON category = l_partkey")
def onehot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many categories as there are parts: a table joined to the rows, and one value a row."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    out = api.fit_sparse_one_hot(rows, "L_PARTKEY", "line").transform(rows)
    return out.select("l_orderkey", "l_linenumber", F.col("onehot.size").alias("size"), F.col("onehot.indices")[0].alias("place"), F.col("onehot.values")[0].alias("value"))


@_query(f"SELECT l_orderkey, l_linenumber, place FROM lineitem JOIN {_FIRST.format('l_returnflag')} ON category = l_returnflag")
def onehot_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    model = OneHotEncoder().fit(rows, "l_returnflag", "line")
    at = F.array(*(F.col(f"onehot_{i}") for i in range(model.num_categories)))
    return model.transform(rows).select("l_orderkey", "l_linenumber", (F.array_position(at, F.lit(1.0)) - 1).alias("place"))


# k-means

_POINTS = ("l_quantity", "l_discount * 100")
_INIT2 = ((5.0, 1.0), (25.0, 5.0), (25.0, 9.0), (45.0, 5.0))
_INIT1 = ((1.0,), (50.0,), (100.0,))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("x1"))


@_query(f"WITH {sql.kmeans('lineitem', _POINTS, _INIT2, 1)} SELECT CAST(cl AS INTEGER) AS cluster, count(*) AS n FROM a1 GROUP BY cl")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KMeansModel(("x0", "x1"), _INIT2).transform(_points(spark, sf_dir)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id < 4), "
    "a AS (SELECT e.vec_id, list_min(list({'d': round(list_distance(e.embedding::DOUBLE[], c.p), 9), 'i': c.vec_id})) AS best FROM embeddings e, c GROUP BY e.vec_id) SELECT vec_id, CAST(best.i AS INTEGER) AS cluster FROM a"
)
def kmeans_predict_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centroids = tuple(tuple(map(float, r.embedding)) for r in rows.filter("vec_id < 4").orderBy("vec_id").collect())
    return KMeansModel(("embedding",), centroids).transform(rows).select("vec_id", "cluster")


@_query(sql.kmeans_query("events", ["value"], _INIT1, 5))
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = KMeans(3, 5, 0.0, initial_centroids=_INIT1).fit(_read(spark, sf_dir, "events"), ["value"])
    return _rounded(model.frame(spark), 6, "value")


@_query(sql.kmeans_query("lineitem", _POINTS, _INIT2, 4))
def kmeans_fit_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = KMeans(4, 4, 0.0, initial_centroids=_INIT2).fit(_points(spark, sf_dir), ["x0", "x1"])
    return _rounded(model.frame(spark), 6, "value")


@_query(sql.kmeans_query("events", ["value"], ((1.0,), (50.0,), (1e9,)), 3))
def kmeans_empty_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = KMeans(3, 3, 0.0, initial_centroids=((1.0,), (50.0,), (1e9,))).fit(_read(spark, sf_dir, "events"), ["value"])
    return _rounded(model.frame(spark), 6, "value")


@_query(f"WITH {sql.kmeans('lineitem', _POINTS, _INIT2, 2)} SELECT CAST(id AS INTEGER) AS cluster, round(x0 * x0 + x1 * x1, 5) AS norm FROM c2")
def kmeans_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = KMeans(4, 2, 0.0, initial_centroids=_INIT2).fit(_points(spark, sf_dir), ["x0", "x1"])
    return spark.createDataFrame(list(enumerate(model.centroid_norms_sq)), "cluster int, norm double").withColumn("norm", F.round("norm", 5))


_LINE = "(SELECT *, l_orderkey * 8 + l_linenumber AS line FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("x1"))


@_query(f"WITH {sql.kmeans('lineitem', _POINTS, sql.kmeans_seeds(_LINE, 'line', _POINTS, 5, 24), 5)} SELECT CAST(cl AS INTEGER) AS cluster, count(*) AS count FROM a5 GROUP BY cl")
def kmeans_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn seeds and five steps; the counts are those of the last assignment."""
    rows = _lines(spark, sf_dir)
    return KMeans(5, 4, 0.0).fit(rows, ["x0", "x1"], "line").transform(rows).groupBy("cluster").count()


@_query(f"WITH {sql.kmeans_seeds(_LINE, 'line', _POINTS, 12, 24)} SELECT CAST(id AS INTEGER) AS cluster, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM c0")
def kmeans_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve drawn seeds, without a step."""
    model = KMeans(12, 0).fit(_lines(spark, sf_dir), ["x0", "x1"], "line")
    return _rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(model.centroids)], "cluster int, x0 double, x1 double"), 6, "x0", "x1")


# Linear models

_REG = "(SELECT l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y FROM lineitem)"


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))


def _solved(alpha: float, centred: bool) -> str:
    def s(x: str, y: str) -> str:
        return f"covar_pop({x}, {y}) * count(*)" if centred else f"sum({x} * {y})"

    ridge = alpha if alpha > 0 else 1e-6
    return (
        f"WITH m AS (SELECT {s('a', 'a')} + {ridge} AS aa, {s('b', 'b')} + {ridge} AS bb, {s('a', 'b')} AS ab, {s('a', 'y')} AS ay, {s('b', 'y')} AS byy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM {_REG}), "
        f"w AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS wa, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM m), "
        f"f AS (SELECT wa, wb, {'my - wa * ma - wb * mb' if centred else '0.0'} AS c FROM w) "
    )


def _weights(spark: SparkSession, model) -> DataFrame:
    return _rounded(spark.createDataFrame([(*model.weights, model.intercept)], "wa double, wb double, c double"), 6, "wa", "wb", "c")


_SHOWN = "SELECT round(wa, 6) + 0.0 AS wa, round(wb, 6) + 0.0 AS wb, round(CAST(c AS DOUBLE), 6) + 0.0 AS c FROM f"


@_query(_solved(0.0, True) + _SHOWN)
def linreg_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, LinearRegression().fit(_regression(spark, sf_dir), ["a", "b"], "y"))


@_query(_solved(50.0, True) + _SHOWN)
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, LinearRegression(50.0).fit(_regression(spark, sf_dir), ["a", "b"], "y"))


@_query(_solved(50.0, False) + _SHOWN)
def ridge_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, LinearRegression(50.0, fit_intercept=False).fit(_regression(spark, sf_dir), ["a", "b"], "y"))


@_query(_solved(0.0, True) + f"SELECT a, b, y, round(wa * a + wb * b + c, 4) + 0.0 AS prediction FROM {_REG}, f")
def linreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regression(spark, sf_dir)
    return _rounded(LinearRegression().fit(rows, ["a", "b"], "y").transform(rows), 4, "prediction")


_LOGIT = "(SELECT l_quantity / 50 AS u, l_extendedprice / 100000 AS v, CASE WHEN l_returnflag = 'R' OR l_quantity > 30 THEN 1.0 ELSE 0.0 END AS y FROM lineitem)"


def _logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_quantity") / 50).alias("u"), (F.col("l_extendedprice") / 100000).alias("v"), F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 30), 1.0).otherwise(0.0).alias("y"))


_LOGIT_FIT = f"WITH {sql.logistic(_LOGIT, ['u', 'v'], 'y', 6, 0.5, 0.001)} "


def _logit_model(spark: SparkSession, sf_dir: str):
    return LogisticRegression(0.5, 6, 0.001).fit(_logit(spark, sf_dir), ["u", "v"], "y")


@_query(_LOGIT_FIT + "SELECT round(w0, 8) AS wu, round(w1, 8) AS wv, round(b, 8) AS b FROM w6")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _logit_model(spark, sf_dir)
    return _rounded(spark.createDataFrame([(*m.weights, m.bias)], "wu double, wv double, b double"), 8, "wu", "wv", "b")


@_query(_LOGIT_FIT + "SELECT CASE WHEN x0 * w0 + x1 * w1 + b >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, count(*) AS n FROM xs, w6 GROUP BY 1")
def logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logit_model(spark, sf_dir).transform(_logit(spark, sf_dir)).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@_query(_LOGIT_FIT + "SELECT x0 AS u, x1 AS v, round(1.0 / (1.0 + exp(-(x0 * w0 + x1 * w1 + b))), 5) AS p FROM xs, w6")
def logistic_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_logit_model(spark, sf_dir).transform(_logit(spark, sf_dir), "prediction", "p").select("u", "v", "p"), 5, "p")


_SGD = "(SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal / 10000 AS u, s_nationkey / 25.0 AS v, CASE WHEN s_acctbal > 4000 THEN 1.0 ELSE 0.0 END AS y FROM supplier)"
_SGD_EPOCHS, _SGD_RATE, _SGD_L2 = 3, 0.2, 0.001


@_query(
    f"WITH RECURSIVE x AS {_SGD}, n AS (SELECT count(*) AS n FROM x), "
    "w AS (SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS wu, CAST(0 AS DOUBLE) AS wv, CAST(0 AS DOUBLE) AS b "
    f"UNION ALL SELECT t + 1, wu - {_SGD_RATE} / (1 + 0.01 * (t // n)) * (off * u + {_SGD_L2} * wu), wv - {_SGD_RATE} / (1 + 0.01 * (t // n)) * (off * v + {_SGD_L2} * wv), b - {_SGD_RATE} / (1 + 0.01 * (t // n)) * off "
    f"FROM (SELECT w.*, n.n, x.u, x.v, 1.0 / (1.0 + exp(-(wu * x.u + wv * x.v + b))) - x.y AS off FROM w, n, x WHERE x.k = w.t % n.n AND w.t < {_SGD_EPOCHS} * n.n)) "
    "SELECT round(wu, 6) AS wu, round(wv, 6) AS wv, round(b, 6) AS b FROM w ORDER BY t DESC LIMIT 1"
)
def logistic_sgd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("u"), (F.col("s_nationkey") / 25.0).alias("v"), F.when(F.col("s_acctbal") > 4000, 1.0).otherwise(0.0).alias("y"))
    m = LogisticRegression(_SGD_RATE, _SGD_EPOCHS, _SGD_L2, "sgd").fit(rows.coalesce(1), ["u", "v"], "y", "s_suppkey")
    return _rounded(spark.createDataFrame([(*m.weights, m.bias)], "wu double, wv double, b double"), 6, "wu", "wv", "b")


@_query("WITH f AS (SELECT regr_slope(l_extendedprice / 1000, l_quantity) AS w, regr_intercept(l_extendedprice / 1000, l_quantity) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(w * l_quantity + c, 3) + 0.0 AS prediction FROM lineitem, f")
def linreg_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature given twice: the normal equations are singular but for the jitter, and predictions are those of one."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_quantity").alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))
    return _rounded(LinearRegression().fit(rows, ["a", "b"], "y").transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 3, "prediction")


# Principal components

_PAIR = "(SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem)"
_PCA = (
    f"WITH s AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, avg(a) AS ma, avg(b) AS mb FROM {_PAIR}), "
    "e AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l0, (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l1 FROM s), "
    "v AS (SELECT *, ab / sqrt(ab * ab + (l0 - aa) * (l0 - aa)) AS p, (l0 - aa) / sqrt(ab * ab + (l0 - aa) * (l0 - aa)) AS q FROM e), "
    "k AS (SELECT *, CASE WHEN (abs(p) >= abs(q) AND p < 0) OR (abs(q) > abs(p) AND q < 0) THEN -1 ELSE 1 END AS s0, CASE WHEN (abs(q) >= abs(p) AND -q < 0) OR (abs(p) > abs(q) AND p < 0) THEN -1 ELSE 1 END AS s1 FROM v), "
    "c AS (SELECT *, p * s0 AS c00, q * s0 AS c01, -q * s1 AS c10, p * s1 AS c11 FROM k) "
)


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))


@_query(_PCA + "SELECT CAST(0 AS INTEGER) AS component, round(l0, 5) AS variance, round(l0 / (aa + bb), 7) AS ratio FROM c UNION ALL SELECT 1, round(l1, 5), round(l1 / (aa + bb), 7) FROM c")
def pca_2d_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PCA(2).fit(_pair(spark, sf_dir), ["a", "b"])
    rows = spark.createDataFrame(list(zip(range(2), m.explained_variance, m.explained_variance_ratio, strict=True)), "component int, variance double, ratio double")
    return _rounded(_rounded(rows, 5, "variance"), 7, "ratio")


@_query(_PCA + "SELECT CAST(0 AS INTEGER) AS component, round(c00, 6) AS a, round(c01, 6) AS b FROM c UNION ALL SELECT 1, round(c10, 6), round(c11, 6) FROM c")
def pca_2d_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PCA(2).fit(_pair(spark, sf_dir), ["a", "b"])
    return _rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(m.components)], "component int, a double, b double"), 6, "a", "b")


@_query(_PCA + f"SELECT x.a, x.b, round((x.a - ma) * c00 + (x.b - mb) * c01, 4) + 0.0 AS pc0, round((x.a - ma) * c10 + (x.b - mb) * c11, 4) + 0.0 AS pc1 FROM {_PAIR} x, c")
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair(spark, sf_dir)
    return _rounded(PCA(2).fit(rows, ["a", "b"]).transform(rows), 4, "pc0", "pc1")


@_query(_PCA + f"SELECT x.a, x.b, round(((x.a - ma) * c00 + (x.b - mb) * c01) * c00 + ma, 4) + 0.0 AS back_a, round(((x.a - ma) * c00 + (x.b - mb) * c01) * c01 + mb, 4) + 0.0 AS back_b FROM {_PAIR} x, c")
def pca_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair(spark, sf_dir)
    m = PCA(1).fit(rows, ["a", "b"])
    return _rounded(m.inverse(m.transform(rows)).drop("pc0"), 4, "back_a", "back_b")


@_query()
def pca_64d_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PCA(8).fit(_read(spark, sf_dir, "embeddings").select("embedding"), ["embedding"])
    return spark.createDataFrame(list(enumerate(m.explained_variance_ratio)), "component int, ratio double")


_CELLS = "(SELECT i, j, {} FROM embeddings, range(64) a(i), range(64) b(j) GROUP BY i, j)"


@_query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 4) + 0.0 AS value FROM " + _CELLS.format("sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE) AS value"))
def gram_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gram_matrix(_read(spark, sf_dir, "embeddings").select("embedding"), ["embedding"])
    return _rounded(spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "i int, j int, value double"), 4, "value")


@_query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 7) + 0.0 AS value FROM " + _CELLS.format("covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) AS value"))
def covariance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments(_read(spark, sf_dir, "embeddings").select("embedding"), ["embedding"]).covariance
    return _rounded(spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "i int, j int, value double"), 7, "value")


@_query("SELECT round(sum(CASE WHEN i = j THEN value ELSE 0 END), 6) AS trace, round(sum(value * value), 6) AS squares, CAST(64 AS BIGINT) AS components FROM " + _CELLS.format("covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) AS value"))
def pca_64d_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variances of the embeddings: they sum to the trace of the covariance, and their squares to the squares of its cells."""
    m = PCA(64).fit(_read(spark, sf_dir, "embeddings").select("embedding"), ["embedding"])
    v = m.explained_variance
    return _rounded(spark.createDataFrame([(sum(v), sum(x * x for x in v), len(v))], "trace double, squares double, components long"), 6, "trace", "squares")


@_query("SELECT CAST(0 AS INTEGER) AS i, round(8.0, 6) AS ones, round(0.0, 6) AS rest UNION ALL SELECT CAST(1 AS INTEGER), round(8.0, 6), round(0.0, 6)")
def pca_64d_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight components V under the covariance C: the diagonals of VV' and of VCV' over the variances sum to 8, all else is 0."""
    rows = _read(spark, sf_dir, "embeddings").select("embedding")
    m = PCA(8).fit(rows, ["embedding"])
    v, c = np.array(m.components), moments(rows, ["embedding"]).covariance
    out = []
    for i, product in enumerate((v @ v.T, v @ c @ v.T / np.array(m.explained_variance)[:, None])):
        out.append((i, float(np.trace(product)), float(np.abs(product - np.diag(np.diag(product))).sum())))
    return _rounded(spark.createDataFrame(out, "i int, ones double, rest double"), 6, "ones", "rest")


# Array columns

_PLACES = "(SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"
_VECTOR_INIT = "c0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 3)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _unfolded(rows: DataFrame, digits: int) -> DataFrame:
    return _rounded(rows.select("vec_id", F.posexplode("embedding").alias("dimension", "value")), digits, "value")


@_query(f"SELECT vec_id, CAST(i AS INTEGER) AS dimension, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS value FROM {_PLACES} WINDOW w AS (PARTITION BY i)")
def vector_std_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return _unfolded(StandardScaler().fit(rows, ["embedding"]).transform(rows), 6)


@_query(f"SELECT vec_id, CAST(i AS INTEGER) AS dimension, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) + 0.0 AS value FROM {_PLACES} WINDOW w AS (PARTITION BY i)")
def vector_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return _unfolded(MinMaxScaler().fit(rows, ["embedding"]).transform(rows), 6)


def _vector_steps(n: int) -> str:
    out = [_VECTOR_INIT]
    for t in range(n):
        out.append(f"a{t} AS (SELECT e.vec_id, list_min(list({{'d': list_distance(e.embedding::DOUBLE[], c.v), 'i': c.id}})).i AS cl FROM embeddings e, c{t} c GROUP BY e.vec_id)")
        out.append(f"c{t + 1} AS (SELECT cl AS id, list(m ORDER BY i) AS v FROM (SELECT cl, i, avg(v) AS m FROM a{t} JOIN {_PLACES} USING (vec_id) GROUP BY cl, i) GROUP BY cl)")
    return ", ".join(out)


@_query(f"WITH {_vector_steps(3)} SELECT CAST(id AS INTEGER) AS cluster, CAST(i AS INTEGER) AS dimension, round(v[i + 1], 6) + 0.0 AS value FROM c3, range(64) r(i)")
def vector_kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    start = [r.embedding for r in rows.filter("vec_id < 3").orderBy("vec_id").collect()]
    return _rounded(KMeans(3, 3, 0.0, initial_centroids=start).fit(rows, ["embedding"]).frame(spark), 6, "value")


@_query("SELECT vec_id, round(3 * embedding[1]::DOUBLE - 2 * embedding[2]::DOUBLE + 1, 4) + 0.0 AS prediction FROM embeddings")
def vector_linreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that is linear in two places of a vector of 64: the predictions are the label."""
    rows = _embeddings(spark, sf_dir).withColumn("y", 3 * F.col("embedding")[0].cast("double") - 2 * F.col("embedding")[1].cast("double") + 1)
    return _rounded(LinearRegression(1e-9).fit(rows, ["embedding"], "y").transform(rows).select("vec_id", "prediction"), 4, "prediction")


@_query("SELECT vec_id, round(3 * embedding[1]::DOUBLE - 2 * embedding[2]::DOUBLE + 1, 4) + 0.0 AS prediction FROM embeddings")
def vector_linreg_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same label by conjugate gradients, as for very wide data."""
    rows = _embeddings(spark, sf_dir).withColumn("y", 3 * F.col("embedding")[0].cast("double") - 2 * F.col("embedding")[1].cast("double") + 1)
    return _rounded(LinearRegression(1e-9, solver="gradients").fit(rows, ["embedding"], "y").transform(rows).select("vec_id", "prediction"), 4, "prediction")


@_query("SELECT CAST(i AS INTEGER) AS component, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS residual, round((SELECT sum(c) FROM (SELECT var_samp(v) AS c FROM " + _PLACES + " GROUP BY i)), 6) AS trace FROM range(8) r(i)")
def pca_krylov_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components sought without a covariance: each has norm 1, and the covariance takes it to its variance times itself."""
    rows = _embeddings(spark, sf_dir).select("embedding")
    m = PCA(8, "krylov").fit(rows, ["embedding"])
    v, c = np.array(m.components), moments(rows, ["embedding"]).covariance
    off = np.abs(v @ c - np.array(m.explained_variance)[:, None] * v).sum(1)
    out = [(i, float((v[i] ** 2).sum()), float(off[i]), m.explained_variance[i] / m.explained_variance_ratio[i]) for i in range(8)]
    return _rounded(spark.createDataFrame(out, "component int, norm double, residual double, trace double"), 6, "norm", "residual", "trace")


_VECTOR_LOGIT = (
    f"WITH x AS (SELECT vec_id, list(v ORDER BY i) AS v, CASE WHEN list(v ORDER BY i)[1] > 0 THEN 1.0 ELSE 0.0 END AS y FROM {_PLACES} GROUP BY vec_id), w0 AS (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS b), "
    + ", ".join(
        f"o{t} AS (SELECT x.*, 1.0 / (1.0 + exp(-(list_inner_product(x.v, w.w) + w.b))) - y AS off FROM x, w{t} w), "
        f"w{t + 1} AS (SELECT list(w.w[i + 1] - {0.5 / (1 + 0.01 * t)!r} * (g + 0.001 * w.w[i + 1]) ORDER BY i) AS w, any_value(w.b - {0.5 / (1 + 0.01 * t)!r} * h) AS b FROM (SELECT i, avg(off * v[i + 1]) AS g, avg(off) AS h FROM o{t}, range(64) r(i) GROUP BY i), w{t} w)"
        for t in range(4)
    )
)


@_query(_VECTOR_LOGIT + " SELECT CAST(i AS INTEGER) AS dimension, round(w[i + 1], 7) + 0.0 AS weight FROM w4, range(64) r(i)")
def vector_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumn("y", (F.col("embedding")[0] > 0).cast("double"))
    model = LogisticRegression(0.5, 4, 0.001).fit(rows, ["embedding"], "y")
    return _rounded(spark.createDataFrame(list(enumerate(model.weights)), "dimension int, weight double"), 7, "weight")


# Trees

_ORDERS = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_totalprice > 180000 OR o_orderpriority < '2' THEN 1 ELSE 0 END AS y, o_totalprice AS f0, CAST(o_custkey AS DOUBLE) AS f1 FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.when((F.col("o_totalprice") > 180000) | (F.col("o_orderpriority") < "2"), 1.0).otherwise(0.0).alias("y"), F.col("o_totalprice").alias("f0"), F.col("o_custkey").cast("double").alias("f1"))


@_query(f"WITH rows AS {_ORDERS}, " + sql.split("b", "rows", 1) + " SELECT t AS threshold, round(gain, 9) AS gain FROM b")
def gini_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gini_candidates(_orders(spark, sf_dir), "f0", "y", "o_orderkey"), 9, "gain")


_DEPTH_2 = f"WITH rows AS {_ORDERS}, " + ", ".join([sql.split("b0", "rows", 2), sql.side("r1", "rows", "b0", 2, True), sql.side("r2", "rows", "b0", 2, False), sql.split("b1", "r1", 2), sql.split("b2", "r2", 2)])


@_query(_DEPTH_2 + " SELECT CAST(f AS INTEGER) AS feature, t AS threshold FROM b0 UNION ALL SELECT CAST(f AS INTEGER), t FROM b1 UNION ALL SELECT CAST(f AS INTEGER), t FROM b2")
def tree_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = DecisionTree(max_depth=2).fit(_orders(spark, sf_dir), ["f0", "f1"], "y", "o_orderkey")
    return model.frame(spark).filter("NOT is_leaf").select("feature", "threshold")


def _leaf(rows: str) -> str:
    return f"(SELECT CASE WHEN 2 * sum(y) >= count(*) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {rows})"


_LEAVES = ", ".join([_DEPTH_2, *(sql.side(f"q{i}{s}", f"r{i}", f"b{i}", 2, s == "l") for i in (1, 2) for s in "lr")])
_PREDICTED = " UNION ALL ".join([f"SELECT pos, {_leaf(f'q{i}{s}')} AS prediction FROM q{i}{s}" for i in (1, 2) for s in "lr"] + [f"SELECT pos, {_leaf(f'r{i}')} FROM r{i} WHERE NOT EXISTS (SELECT 1 FROM b{i})" for i in (1, 2)])


@_query(_LEAVES + f" SELECT prediction, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM ({_PREDICTED}) GROUP BY prediction")
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    model = DecisionTree(max_depth=2).fit(rows, ["f0", "f1"], "y", "o_orderkey")
    numbered = rows.withColumn("pos", F.col("o_orderkey") - rows.agg(F.min("o_orderkey")).first()[0])
    return model.transform(numbered).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


_CHAIN = tuple(5.0 * (k + 1) for k in range(9))


@_query("SELECT l_orderkey, l_linenumber, CASE " + " ".join(f"WHEN l_quantity <= {t} THEN {k % 2}.0::DOUBLE" for k, t in enumerate(_CHAIN)) + " ELSE 1.0::DOUBLE END AS prediction FROM lineitem")
def tree_predict_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of nine levels, which is applied in Arrow batches."""
    nodes = []
    for k, t in enumerate(_CHAIN):
        nodes += [Node.branch(0, t, 2 * k + 1, 2 * k + 2), Node.leaf(float(k % 2))]
    model = DecisionTreeModel(("l_quantity",), (*nodes, Node.leaf(1.0)), len(_CHAIN), 2)
    return model.transform(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).drop("l_quantity")


@_query("SELECT o_orderkey, round(votes / 100.0, 6) AS probability, CASE WHEN votes >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM (SELECT o_orderkey, (SELECT count(*) FROM range(100) r WHERE NOT o_totalprice <= 3000.0 * r.range) AS votes FROM orders)")
def forest_predict_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred stumps, which are applied in Arrow batches."""
    model = RandomForestModel(("o_totalprice",), tuple((Node.branch(0, 3000.0 * k, 1, 2), Node.leaf(0.0), Node.leaf(1.0)) for k in range(100)), 1)
    return _rounded(model.transform(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).drop("o_totalprice"), 6, "probability")


_HEAP_TREES, _HEAP_DEPTH = 40, 6


def _heap_level(k: int) -> str:
    """The nodes that all trees reach a level below those of w<k>."""
    x = "CASE (tree + node) % 2 WHEN 0 THEN o_totalprice ELSE o_custkey END"
    cut = "CASE (tree + node) % 2 WHEN 0 THEN 5000.0 * ((7 * tree + 13 * node) % 90 + 1) ELSE 10.0 * ((11 * tree + 5 * node) % 140 + 1) END"
    return f"w{k + 1} AS (SELECT o_orderkey, o_totalprice, o_custkey, tree, 2 * node + CASE WHEN {x} <= {cut} THEN 1 ELSE 2 END AS node FROM w{k})"


@_query(
    f"WITH w0 AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, t.range AS tree, 0 AS node FROM orders, range({_HEAP_TREES}) t), "
    + ", ".join(map(_heap_level, range(_HEAP_DEPTH)))
    + f" SELECT o_orderkey, round(sum((tree + node) % 2) / {_HEAP_TREES}.0, 6) AS probability FROM w{_HEAP_DEPTH} GROUP BY o_orderkey"
)
def forest_proba_sql_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty full trees of six levels, whose nodes follow a rule, as one column of SQL functions."""
    inner = 2**_HEAP_DEPTH - 1

    def node(tree: int, i: int) -> Node:
        if i >= inner:
            return Node.leaf(float((tree + i) % 2))
        f = (tree + i) % 2
        return Node.branch(f, 10.0 * ((11 * tree + 5 * i) % 140 + 1) if f else 5000.0 * ((7 * tree + 13 * i) % 90 + 1), 2 * i + 1, 2 * i + 2)

    trees = tuple(tuple(node(t, i) for i in range(2 * inner + 1)) for t in range(_HEAP_TREES))
    model = RandomForestModel(("o_totalprice", "o_custkey"), trees, _HEAP_DEPTH)
    return _rounded(_read(spark, sf_dir, "orders").select("o_orderkey", model.probability().alias("probability")), 6, "probability")


_DRAWS = "SELECT CAST(t.range AS INTEGER) AS tree, d.range AS draw, ('0x' || substr(md5((42 + 31 * t.range)::VARCHAR || ':' || d.range::VARCHAR), 1, 15))::BIGINT % (SELECT count(*) FROM orders) AS pos FROM range(3) t, (SELECT unnest(range(CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT))) AS range) d"


@_query(f"SELECT tree, draw, pos FROM ({_DRAWS})")
def forest_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "orders").count()
    return bootstrap(spark, 3, n, int(n * 0.8))


def _drawn(tree: int) -> str:
    """How often a tree draws an order."""
    return f"len(list_filter({poisson_steps(0.8)}, lambda s: s <= ('0x' || substr(md5('{42 + 31 * tree}:' || o_orderkey::VARCHAR), 1, 15))::BIGINT))"


_KEYED = _ORDERS.replace("(SELECT ", "(SELECT o_orderkey, ", 1)
_STUMPS = f"WITH rows AS {_KEYED}, " + ", ".join(
    f"s{t} AS (SELECT r.* FROM (SELECT *, unnest(range({_drawn(t)})) FROM rows) x JOIN rows r USING (pos)), {sql.split(f'b{t}', f's{t}', 2)}, {sql.side(f'l{t}', f's{t}', f'b{t}', 2, True)}, {sql.side(f'h{t}', f's{t}', f'b{t}', 2, False)}"
    for t in range(3)
)


def _vote(t: int) -> str:
    low = f"(CASE (SELECT f FROM b{t}) WHEN 0 THEN f0 ELSE f1 END <= (SELECT t FROM b{t}))"
    return f"(CASE WHEN NOT EXISTS (SELECT 1 FROM b{t}) THEN {_leaf(f's{t}')} WHEN {low} THEN {_leaf(f'l{t}')} ELSE {_leaf(f'h{t}')} END)"


_PROBABILITY = f"SELECT y, ({' + '.join(map(_vote, range(3)))}) / 3.0 AS p FROM rows"


def _stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return api.fit_random_forest(rows, "Y", ["F0", "F1"], "o_orderkey", num_trees=3, max_depth=1).transform(rows)


@_query(_STUMPS + f" SELECT round(p, 6) AS probability, count(*) AS n FROM ({_PROBABILITY}) GROUP BY 1")
def forest_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stumps(spark, sf_dir).groupBy(F.round("probability", 6).alias("probability")).agg(F.count(F.lit(1)).alias("n"))


@_query(_STUMPS + f" SELECT CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, CAST(sum(y) AS DOUBLE) AS positives, count(*) AS n FROM ({_PROBABILITY}) GROUP BY 1")
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stumps(spark, sf_dir).groupBy("prediction").agg(F.sum("y").alias("positives"), F.count(F.lit(1)).alias("n"))


# Fits from a DataFrame in one call


@_query("SELECT o_orderkey, CAST(t.range AS INTEGER) AS tree, CAST(CASE t.range " + " ".join(f"WHEN {t} THEN {_drawn(t)}" for t in range(3)) + " END AS INTEGER) AS draws FROM orders, range(3) t")
def forest_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.posexplode(multiplicities(F.col("o_orderkey"), 3, 0.8)).alias("tree", "draws"))


_FOREST = (
    f"WITH rows AS {_KEYED}, "
    + ", ".join(f"d{t} AS (SELECT r.* FROM (SELECT *, unnest(range({_drawn(t)})) FROM rows) x JOIN rows r USING (pos)), {sql.tree(f't{t}', f'd{t}', 2, 4)}, {sql.routed(f'v{t}', 'rows', f't{t}', 2, 4)}" for t in range(5))
    + f", votes AS (SELECT pos, ({' + '.join(f'v{t}.value' for t in range(5))}) / 5.0 AS p FROM v0 {' '.join(f'JOIN v{t} USING (pos)' for t in range(1, 5))})"
)


@_query(_FOREST + " SELECT CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction, count(*) AS count FROM votes GROUP BY 1")
def df_fit_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return api.fit_random_forest(rows, "y", ["f0", "f1"], "o_orderkey", num_trees=5, max_depth=4).transform(rows).groupBy("prediction").count()


@_query(_FOREST + " SELECT round(p, 6) AS probability, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM votes GROUP BY 1")
def forest_deep_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five trees of four levels: the votes of every order."""
    rows = _orders(spark, sf_dir)
    numbered = rows.withColumn("pos", F.col("o_orderkey") - rows.agg(F.min("o_orderkey")).first()[0])
    voted = api.fit_random_forest(rows, "y", ["f0", "f1"], "o_orderkey", num_trees=5, max_depth=4).transform(numbered)
    return voted.groupBy(F.round("probability", 6).alias("probability")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


_DEEP = f"WITH rows AS {_ORDERS}, {sql.tree('t', 'rows', 2, 5)} SELECT CAST(node AS INTEGER) AS node, CAST(coalesce(f, -1) AS INTEGER) AS feature, coalesce(t, 0.0::DOUBLE) AS threshold, CASE WHEN f IS NULL THEN value ELSE 0.0::DOUBLE END AS value FROM t WHERE value IS NOT NULL"


@_query(_DEEP)
def tree_fit_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of five levels: every split and leaf, numbered as in a heap."""
    model = DecisionTree(max_depth=5).fit(_orders(spark, sf_dir), ["f0", "f1"], "y", "o_orderkey")
    out, todo = [], [(0, 0)]
    while todo:
        at, heap = todo.pop()
        node = model.nodes[at]
        out.append((heap, node.feature, node.threshold, node.value))
        todo += [] if node.is_leaf else [(node.left, 2 * heap + 1), (node.right, 2 * heap + 2)]
    return spark.createDataFrame(out, "node int, feature int, threshold double, value double")


@_query(sql.kmeans_query("events", ["value"], sql.kmeans_seeds("events", "event_id", ["value"], 3, 24), 5))
def df_fit_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    return _rounded(api.fit_kmeans(rows, ["VALUE"], k=3, max_iterations=5, id_col="event_id").frame(spark), 6, "value")


@_query(_PCA + "SELECT CAST(0 AS INTEGER) AS component, round(l0 / (aa + bb), 7) AS ratio FROM c UNION ALL SELECT 1, round(l1 / (aa + bb), 7) FROM c")
def df_fit_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = api.fit_pca(to_features(_pair(spark, sf_dir), ["A", "B"]), ["A", "B"])
    return _rounded(spark.createDataFrame(list(enumerate(m.explained_variance_ratio)), "component int, ratio double"), 7, "ratio")
