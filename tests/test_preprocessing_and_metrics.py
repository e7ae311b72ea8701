import numpy as np
import pytest

from quillspark import api
from quillspark.operators import metrics
from quillspark.operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler
from quillspark.sources.features import from_columns

NAN = float("nan")


def test_standard_scaler_uses_population_deviation(spark):
    df = from_columns(spark, {"a": [1.0, 2.0, 4.0], "k": [5.0, 5.0, 5.0]})
    m = StandardScaler().fit(df, ["a", "k"])
    assert m.std_devs == pytest.approx((np.std([1, 2, 4]), 1.0)) and m.means == pytest.approx((7 / 3, 5.0))
    rows = m.transform(df).collect()
    assert sum(r.a for r in rows) == pytest.approx(0) and {r.k for r in rows} == {0.0}
    assert [r.row_id for r in rows] == [0, 1, 2]


def test_nan_spoils_the_mean_but_not_the_range(spark):
    df = from_columns(spark, {"a": [1.0, NAN, 3.0]})
    assert np.isnan(StandardScaler().fit(df, ["a"]).means[0])
    m = MinMaxScaler().fit(df, ["a"])
    assert (m.mins, m.maxs) == ((1.0,), (3.0,))


def test_minmax_constant_is_zero_and_unseen_values_are_not_clamped(spark):
    m = MinMaxScaler().fit(from_columns(spark, {"a": [0.0, 10.0], "k": [3.0, 3.0]}), ["a", "k"])
    rows = m.transform(from_columns(spark, {"a": [-10.0, 20.0], "k": [3.0, 3.0]})).collect()
    assert [(r.a, r.k) for r in rows] == [(-1.0, 0.0), (2.0, 0.0)]


def test_minmax_then_standard(spark):
    df = from_columns(spark, {"a": [10.0, 20.0, 30.0, 40.0], "b": [100.0, 200.0, 300.0, 400.0]})
    scaled = MinMaxScaler().fit(df, ["a", "b"]).transform(df)
    assert [(r.a, r.b) for r in scaled.collect()][0] == (0.0, 0.0)
    out = StandardScaler().fit(scaled, ["a", "b"]).transform(scaled).toPandas()
    assert out[["a", "b"]].mean().abs().max() < 1e-12


def test_scalers_need_rows(spark):
    with pytest.raises(ValueError):
        StandardScaler().fit(spark.createDataFrame([], "a double"), ["a"])


@pytest.mark.parametrize(("values", "order"), [([10, 20, 10, 30, 20], (10, 20, 30)), ([5, 9, 5], (5, 9))])
def test_one_hot_by_first_occurrence(spark, values, order):
    df = spark.createDataFrame(list(enumerate(values)), "id int, c int")
    m = OneHotEncoder().fit(df, "c", "id")
    assert m.categories == order and m.num_categories == len(order)
    rows = m.transform(df.union(spark.createDataFrame([(99, 77), (100, None)], "id int, c int"))).orderBy("id").collect()
    for r, v in zip(rows, values, strict=False):
        assert [r[f"onehot_{i}"] for i in range(len(order))] == [float(v == c) for c in order]
    assert all(r[f"onehot_{i}"] == 0.0 for r in rows[-2:] for i in range(len(order)))
    with pytest.raises(ValueError):
        OneHotEncoder(max_categories=1).fit(df, "c", "id")
    assert api.fit_one_hot(df, "C", "id").categories == order


def _pairs(spark, actual, predicted):
    return spark.createDataFrame(list(zip(map(float, actual), map(float, predicted), strict=True)), "a double, p double")


def test_accuracy_rounds_half_to_even(spark):
    assert metrics.accuracy(_pairs(spark, [1, 0, 1, 1, 0], [1, 0, 0, 1, 0]), "a", "p") == pytest.approx(0.8)
    assert metrics.accuracy(_pairs(spark, [0.5, 1.5, 2.5], [0, 2, 2]), "a", "p") == 1.0
    assert metrics.accuracy(_pairs(spark, [NAN, 1], [NAN, 1]), "a", "p") == 0.5
    assert metrics.accuracy(spark.createDataFrame([], "a double, p double"), "a", "p") == 0.0


def test_mse_and_r2(spark):
    assert metrics.mean_squared_error(_pairs(spark, [1, 2, 3, 4], [2, 3, 4, 5]), "a", "p") == 1.0
    assert metrics.mean_squared_error(spark.createDataFrame([], "a double, p double"), "a", "p") == 0.0
    assert metrics.r2_score(_pairs(spark, [3, -0.5, 2, 7], [2.5, 0, 2, 8]), "a", "p") == pytest.approx(0.9486, abs=1e-4)
    assert metrics.r2_score(_pairs(spark, [4, 4], [1, 9]), "a", "p") == 1.0
    with pytest.raises(ValueError):
        metrics.r2_score(spark.createDataFrame([], "a double, p double"), "a", "p")


def test_sparse_one_hot_of_many_and_of_string_categories(spark):
    from quillspark import api

    rows = [(i, f"c{i * 7919 % 30_011}" if i % 50 else None, i % 3) for i in range(40_000)]
    df = spark.createDataFrame(rows, "id long, k string, onehot int").repartition(5)
    model = api.fit_sparse_one_hot(df, "K", "id")
    order = list(dict.fromkeys(k for _, k, _ in rows if k))
    assert model.num_categories == len(order) > 20_000
    assert {r["category"]: r["index"] for r in model.table.collect()} == {k: i for i, k in enumerate(order)}
    more = spark.createDataFrame([(1, order[7], 0), (2, None, 0), (3, "new", 0)], df.schema)
    got = {r.id: r.out for r in model.transform(more, "out").collect()}
    assert (got[1].size, got[1].indices, got[1]["values"]) == (len(order), [7], [1.0])
    assert got[2].indices == got[3].indices == [] and got[2]["values"] == []
    model.unpersist()
    few = api.fit_one_hot(df.filter("id < 30"), "k", "id")
    assert few.categories == tuple(k for k in order[: few.num_categories])


def test_sparse_one_hot_of_numbers_ties_and_no_rows(spark):
    from quillspark import api

    df = spark.createDataFrame([(1, 9.0), (1, 4.0), (2, 9.0), (None, 3.0), (5, None)], "id long, k double")
    assert {r["category"]: r["index"] for r in api.fit_sparse_one_hot(df, "k", "id").table.collect()} == {3: 0, 4: 1, 9: 2}
    assert api.fit_sparse_one_hot(df.limit(0), "k", "id").num_categories == 0
