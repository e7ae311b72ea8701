"""Ingest, column builders, bins and vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import expr
from quillspark.operators.histogram import build_histogram, discretize
from quillspark.operators.linear import project
from quillspark.sources import features

NAN = float("nan")


def test_casts_follow_the_request_and_ignore_case(spark):
    df = spark.createDataFrame([(1.5, 10, 7), (2.5, 20, 8), (3.5, 30, 9)], "f1 double, f2 int, other long")
    out = features.to_features(df, ["F2", "f1"])
    assert out.columns == ["F2", "f1"] and [tuple(r) for r in out.collect()] == [(10.0, 1.5), (20.0, 2.5), (30.0, 3.5)]


@pytest.mark.parametrize(("names", "error"), [([], ValueError), (["missing"], KeyError), (["s"], TypeError)])
def test_bad_requests(spark, names, error):
    df = spark.createDataFrame([(1.0, "x")], "a double, s string")
    with pytest.raises(error):
        features.to_features(df, names)


def test_null_policies(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    assert features.to_features(df, ["a"], null_policy="drop").count() == 1
    assert features.to_features(df, ["a"], null_policy="keep").count() == 2
    with pytest.raises(Exception, match="null in column a"):
        features.to_features(df, ["a"]).collect()


def test_only_named_columns_are_read(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2.0 AS a", "id * 3.0 AS b").write.parquet(str(tmp_path / "t"))
    plan = features.read_features(spark, str(tmp_path / "t"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:" in plan and "b:" not in plan.split("ReadSchema")[1]


def test_small_matrices(spark):
    df = features.from_rows(spark, [[1, 2], [3, 4]], ["x", "y"])
    assert [tuple(r) for r in features.row(df, "row_id", 1).collect()] == [(1, 3.0, 4.0)]
    assert [r[0] for r in features.column(df, "Y").collect()] == [2.0, 4.0]
    assert features.with_column(df, "x", F.lit(9.0)).first().x == 9.0
    assert features.value(df, "row_id", 1, "Y") == 4.0 and features.value(df, "row_id", 7, "x") is None
    assert features.to_matrix(df, ["y", "x"], "row_id").tolist() == [[2.0, 1.0], [4.0, 3.0]]
    with pytest.raises(ValueError):
        features.to_matrix(df, ["x"], "row_id", max_rows=1)
    with pytest.raises(ValueError):
        features.from_columns(spark, {"a": [1.0], "b": [1.0, 2.0]})
    with pytest.raises(ValueError):
        features.from_rows(spark, np.zeros((0, 2)))


def test_bins_keep_equal_values_below_and_nan_at_zero(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.5, 1.2, 2.5, 3.8, 5.0, 1.0, 4.0, NAN)], "v double")
    assert [r.bin for r in discretize(df, "v", [1.0, 2.0, 3.0, 4.0]).collect()] == [0, 0, 1, 2, 3, 4, 0, 3, 0]
    with pytest.raises(ValueError):
        expr.bin_index(F.col("v"), [float(i) for i in range(256)])


def test_histogram_has_every_bin(spark):
    rng = np.random.default_rng(3)
    bins, grads = rng.integers(0, 10, 500), rng.uniform(-5, 5, 500)
    df = spark.createDataFrame([(int(b), float(g)) for b, g in zip(bins, grads, strict=True)], "b int, g double")
    got = {r.bin: (r.grad_sum, r.n) for r in build_histogram(df, "b", "g", counts=True).collect()}
    assert len(got) == 256
    for b in range(256):
        assert got[b][0] == pytest.approx(grads[bins == b].sum(), abs=1e-9) and got[b][1] == (bins == b).sum()


def test_sigmoid_clamps_and_keeps_nan(spark):
    df = spark.createDataFrame([(25.0,), (-25.0,), (0.0,), (NAN,)], "z double")
    got = [r[0] for r in df.select(expr.sigmoid(F.col("z"))).collect()]
    assert got[:3] == [1.0, 0.0, 0.5] and math.isnan(got[3])


def test_vectors(spark):
    a, b = [1.5 * i for i in range(9)], [2.5 * i for i in range(9)]
    df = spark.createDataFrame([(a, b, [x + 1 for x in a])], "a array<double>, b array<double>, c array<double>")
    r = df.select(expr.array_add(F.col("a"), F.col("b")), expr.array_fma(F.col("a"), 3.0, F.col("b")), expr.array_dot(F.col("a"), F.col("b")), expr.array_squared_distance(F.col("a"), F.col("c"))).first()
    assert r[0] == pytest.approx([4.0 * i for i in range(9)]) and r[1] == pytest.approx([7.0 * i for i in range(9)])
    assert r[2] == pytest.approx(np.dot(a, b)) and r[3] == pytest.approx(9.0)
    for bad in (expr.array_add, expr.array_dot):
        with pytest.raises(Exception, match="length|shorter"):
            spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>").select(bad(F.col("a"), F.col("b"))).collect()
    assert spark.createDataFrame([([], [])], "a array<double>, b array<double>").select(expr.array_add(F.col("a"), F.col("b"))).first()[0] == []


def test_projection(spark):
    rng = np.random.default_rng(0)
    x, w = rng.uniform(size=(20, 3)), rng.uniform(size=(3, 2))
    out = project(features.from_rows(spark, x), ["f0", "f1", "f2"], w).orderBy("row_id").collect()
    assert np.allclose([[r.y0, r.y1] for r in out], x @ w)
    with pytest.raises(ValueError):
        project(features.from_rows(spark, x), ["f0"], w)
