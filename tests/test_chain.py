"""The chain of a customer's orders beyond what Spark's own recursion goes through."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tallymill.plans import surface

ROWS = [(1, i, datetime(2000, 1, 1) + timedelta(days=10 * i), i + 0.25) for i in range(250)]
ROWS += [(k, 1000 * k + i, datetime(2000, 1, 1) + timedelta(days=i * i * 20), 1.5) for k in range(2, 40) for i in range(15)]
ROWS += [(50, 50000, datetime(2000, 1, 1), 2.0), (50, 50001, datetime(2000, 2, 1), None), (50, 50002, datetime(2000, 3, 1), 3.0), (51, 51000, None, 1.0), (51, 51001, datetime(2000, 1, 1), 1.0), (None, 60000, datetime(2000, 1, 1), 1.0), (None, 60001, datetime(2000, 1, 2), 1.0)]


@pytest.fixture
def few_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_chain_has_no_limit_of_rows_or_steps(spark, tmp_path, few_rows):
    spark.createDataFrame(ROWS, "o_custkey long, o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    found = {tuple(r) for r in surface.QUERIES["recursive_cte"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        expected = {tuple(r) for r in con.sql(surface.ORACLE_SQL["recursive_cte"]).fetchall()}
    assert found == expected
    assert sum(r[0] == 1 for r in found) == 250
