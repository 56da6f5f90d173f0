"""Logs that the queries write and read: their number, and that a user's log stays whole."""

import json
from datetime import datetime, timedelta

import duckdb
import pytest

from tallymill.plans import log_queries, scale_queries
from tallymill.sources.session_logs import Tally, read_gemini
from tallymill.sources.storage import Files

USERS = 400


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i * 7919 % USERS, "view", i % 97 + 0.5, "{}") for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def same_as_sql(spark, tables, module, name):
    found = module.QUERIES[name](spark, tables)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
        expected = con.sql(f"SELECT {', '.join(found.columns)} FROM ({module.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_a_user_has_one_codex_log_however_small_tasks_are_merged(spark, tables):
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        same_as_sql(spark, tables, log_queries, "ingest_codex_logs")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_gemini_logs_of_many_users(spark, tables):
    same_as_sql(spark, tables, log_queries, "ingest_gemini_logs")


def test_caches_over_logs_of_many_users(spark, tables):
    same_as_sql(spark, tables, log_queries, "incremental_refresh")
    same_as_sql(spark, tables, scale_queries, "cache_deletions")


def test_number_of_logs_does_not_follow_the_users(spark, tables, tmp_path):
    root = f"{tmp_path}/logs"
    log_queries.write_claude_logs(log_queries.claude_lines(spark, tables), root)
    assert len(Files(spark).under(root, "*.json")) <= 4 * log_queries.FOLDERS < USERS


def test_gemini_documents_are_not_opened_for_each_number(spark, tmp_path):
    chat = lambda n: {"sessionId": f"g{n}", "messages": [{"timestamp": "2024-01-01T00:00:00", "model": "m", "tokens": {"input": n, "output": "2", "cached": 1e1, "total": n + 3}}]}
    texts = {"one": json.dumps(chat(1)), "many": "﻿" + json.dumps([chat(2), chat(3)], indent=1), "cut": json.dumps([chat(4)])[:-3], "long": json.dumps([chat(5)]) + " " * 5000, "blank": "\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    tally = Tally()
    with tally.gathering(spark):
        rows = read_gemini(spark, [str(tmp_path)], tally, longest=4000)
        assert "Format: JSON" not in rows._jdf.queryExecution().executedPlan().toString()
        found = {(r["session"], r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["total_tokens"]) for r in rows.collect()}
    assert found == {(f"g{n}", n, 2, 10, n + 3) for n in (1, 2, 3)}
    assert tally.counts()["Gemini"] == {"read": 5, "malformed": 1, "too_long": 1, "kept": 3}
