"""The driver contract: queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _sorted(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(r[i] for i in order) for r in rows)


@needs_data
def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF)
    want = tables.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _sorted(got.collect(), got.columns) == _sorted(want.fetchall(), names)


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
