"""Every query with SQL gives the rows of its SQL."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

from lodestone.operators import generic as G
from lodestone.plans import registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_components_and_pages(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (5, 5)], "src long, dst long")
    assert {r["node"]: r["component"] for r in G.components(edges, lambda df: df.cache()).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    with pytest.raises(ValueError):
        G.page(edges, [F.col("src")], 1, 201)
    assert [r["src"] for r in G.page(edges, [F.col("src"), F.col("dst")], 2, 2).collect()] == [5, 7]


def test_unknown_words_are_errors(spark):
    df = spark.createDataFrame([("High",), ("Odd",)], "s string")
    with pytest.raises(Exception, match="unknown word"):
        df.select(G.rank_of("s", {"High": 1})).collect()
