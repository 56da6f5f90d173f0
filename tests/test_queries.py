"""Every named query against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallymill.operators.asof import asof_join
from tallymill.plans import registry
from tallymill.streaming.daily import daily_totals, token_stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(df.columns)
    return df[columns].map(text).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    pd.testing.assert_frame_equal(plain(registry.QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(registry.ORACLE_SQL[name]).df()), check_dtype=False)


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "c"), (None, 1, "n")], "k int, at int, v string")
    got = sorted(((r.k, r.t, r.v) for r in asof_join(left, right, "k", "t", "at", ["v"]).collect()), key=str)
    assert got[:3] == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_streaming_totals(spark, tmp_path):
    from tallymill.plans.standin import tokens

    rows = tokens(spark, DATA)
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    query = daily_totals(token_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("daily").agg({"turns": "sum"}).first()[0] == rows.count()
