"""The ad-hoc SQL surface: users may run any Spark SQL over their tables. Each kind of operation is exercised once here.

A query is one text for both engines where the dialects agree, else one for each. Tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.asof import asof_join

#: Name: text for both engines.
SHARED = {
    "join_inner": "SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS events FROM (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey) a "
    "FULL JOIN (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY user_id) b ON a.k = b.k",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 100000",
    "join_anti": "SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b",
    "join_range": "SELECT p_size, CAST(count(*) AS BIGINT) AS n FROM {part} JOIN {region} ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 9 GROUP BY p_size",
    "exists_subquery": "SELECT s_suppkey, s_name FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s.s_suppkey AND l_discount > 0.05)",
    "in_subquery": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})",
    "correlated_scalar_subquery": "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS largest FROM {customer}",
    "rollup_returnflag": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_segment": "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM {orders} "
    "GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "having_count": "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_partkey HAVING count(*) > 35",
    "aggregate_filter": "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS discounted, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_returnflag",
    "distinct_count": "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM {lineitem} GROUP BY l_returnflag",
    "statistics": "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS deviation, round(var_pop(c_acctbal), 2) AS variance, round(median(c_acctbal), 4) AS middle FROM {customer} GROUP BY c_mktsegment",
    "window_rank": "SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS n "
    "FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)",
    "window_running_sum": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}",
    "window_lag_lead": "SELECT user_id, event_id, lag(event_type) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_frame_average": "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM {events}",
    "window_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter FROM {customer}",
    "topk_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) q WHERE n <= 3",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders}",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 30",
    "case_expression": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'more' END AS standing, nullif(c_mktsegment, 'BUILDING') AS segment FROM {customer}",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, "
    "round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "local_supplier_volume": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region} "
    "WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 2 GROUP BY n_name",
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 2, 4) AS part, replace(p_type, ' ', '_') AS joined, trim(concat('  ', p_brand, ' ')) AS t, lpad(p_brand, 12, '.') AS padded, reverse(p_brand) AS r FROM {part}",
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, concat(CAST(date_trunc('month', o_orderdate) AS DATE), '') AS start, concat(CAST(o_orderdate AS DATE), '') AS d FROM {orders}",
    "math_functions": "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, floor(c_acctbal / 100) AS low, CAST(sign(c_acctbal) AS INTEGER) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, c_custkey % 7 AS rest, greatest(c_acctbal, 0.0) AS g FROM {customer}",
    "cte_chain": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), top AS (SELECT o_custkey, s FROM spend WHERE s > 500000) "
    "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(s), 2) AS spent FROM top JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment",
}

#: Name: text for Spark, text for DuckDB.
EACH = {
    # each customer's orders from the first on, as long as the next one follows within 200 days. Spark's own recursion stops at a million rows
    # or a hundred steps and reads all orders at each step; the chain ends at the first gap, so two windows over the orders tell it
    "recursive_cte": (
        "WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS placed, lag(o_orderdate) OVER w AS before, CAST(round(o_totalprice * 100) AS BIGINT) AS price, CAST(row_number() OVER w AS INTEGER) AS n "
        "FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST)), "
        "chain AS (SELECT *, bool_and(n = 1 OR coalesce(k IS NOT NULL AND placed <= before + INTERVAL 200 DAY, false)) OVER w AS linked, count(price) OVER w AS priced, sum(price) OVER w AS total "
        "FROM o WINDOW w AS (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING)) "
        "SELECT k AS o_custkey, o_orderkey, n AS place, CASE WHEN priced = n THEN total END AS spent FROM chain WHERE linked",
        "WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS placed, o_totalprice AS price, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS n FROM {orders}), "
        "chain(k, o_orderkey, placed, n, spent) AS (SELECT k, o_orderkey, placed, n, CAST(round(price * 100) AS BIGINT) FROM o WHERE n = 1 "
        "UNION ALL SELECT o.k, o.o_orderkey, o.placed, o.n, chain.spent + CAST(round(o.price * 100) AS BIGINT) FROM chain JOIN o ON o.k = chain.k AND o.n = chain.n + 1 AND o.placed <= chain.placed + INTERVAL 200 DAY) "
        "SELECT k AS o_custkey, o_orderkey, n AS place, spent FROM chain",
    ),
    "array_functions": (
        "SELECT user_id, size(a) AS n, array_sort(a)[0] AS first, cast(aggregate(transform(a, x -> x % 10), 0L, (s, x) -> s + x) AS bigint) AS digits FROM (SELECT user_id, collect_list(event_id) AS a FROM {events} GROUP BY user_id)",
        "SELECT user_id, CAST(len(a) AS INTEGER) AS n, list_sort(a)[1] AS first, CAST(list_sum(list_transform(a, lambda x: x % 10)) AS BIGINT) AS digits FROM (SELECT user_id, list(event_id) AS a FROM {events} GROUP BY user_id)",
    ),
    "map_functions": (
        "SELECT user_id, cast(m['click'] AS bigint) AS clicks, size(m) AS kinds FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id)",
        "SELECT user_id, CAST(max(n) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(count(*) AS INTEGER) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id",
    ),
    "arg_max": (
        "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest FROM {orders} GROUP BY o_custkey",
        "SELECT o_custkey, arg_max(o_orderkey, {{'p': o_totalprice, 'k': o_orderkey}}) AS dearest FROM {orders} GROUP BY o_custkey",
    ),
    "percentiles": (
        "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.9), 6) AS p90 FROM {events} GROUP BY event_type",
        "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM {events} GROUP BY event_type",
    ),
    "string_aggregation": (
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    ),
    "pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open, 'F' AS filled))",
        "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS filled FROM {lineitem} GROUP BY l_returnflag",
    ),
    "unpivot": (
        "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM {lineitem}) UNPIVOT (value FOR name IN (l_discount AS `discount`, l_tax AS `tax`))",
        "SELECT l_orderkey, l_linenumber, 'discount' AS name, l_discount AS value FROM {lineitem} UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM {lineitem}",
    ),
    "tumbling_window": (
        "SELECT date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS begins, event_type, n FROM (SELECT window(ts, '1 day') AS w, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 day'), event_type)",
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS begins, event_type, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY 1, 2",
    ),
    "regexp_functions": (
        r"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS shape, url RLIKE '[0-9]' AS numbered FROM {pages}",
        r"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, regexp_matches(url, '[0-9]') AS numbered FROM {pages}",
    ),
}

_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _runner(text: str):
    names = sorted(set(_TABLE.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    return run


def asof_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest order up to that day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") % 2400).alias("day"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dated = orders.select(F.col("o_custkey").alias("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("at"), "o_orderkey")
    return asof_join(events, dated, "k", "day", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


QUERIES = {name: _runner(text) for name, text in SHARED.items()} | {name: _runner(texts[0]) for name, texts in EACH.items()} | {"asof_latest_order": asof_latest_order}

ORACLE_SQL = (
    {name: _TABLE.sub(r"\1", text).replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN") for name, text in SHARED.items()}
    | {name: _TABLE.sub(r"\1", texts[1]).replace("{{", "{").replace("}}", "}") for name, texts in EACH.items()}
    | {
        "asof_latest_order": """SELECT event_id, arg_max(o_orderkey, {'d': placed, 'k': o_orderkey}) AS o_orderkey FROM (SELECT event_id, user_id, event_id % 2400 AS day FROM events) e
LEFT JOIN (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS placed FROM orders) o ON o_custkey = user_id AND placed <= day GROUP BY event_id"""
    }
)
