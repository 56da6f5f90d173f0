"""The log readers run over logs made from `events`, so that their rows can be held against SQL on the same table.

The logs are written as JSON lines to a folder below spark.checkpoint.dir, which driver and executors share, or to a
temporary one where that is unset (local runs). One column of counts is written as text, which the readers take too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.sources.cache import TokenCache, Tree
from tallymill.sources.session_logs import read_claude, read_codex, read_gemini
from tallymill.sources.storage import Files, shared_dir


#: Folders of the logs that a cache is kept of, and lines of the longest log there.
FOLDERS, LOG_LINES = 50, 20_000
#: Users whose chats one document may hold, and messages after which the next chat begins another.
CHATS, MESSAGES = 64, 20_000


def log_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


def _tasks(spark: SparkSession) -> int:
    """Tasks that write logs: named, so that Spark does not merge small ones, which have many files to write."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_claude_logs(lines: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Logs with the sessions of some users each, of up to `LOG_LINES` lines, in a folder for each remainder of the user by `FOLDERS`."""
    folder, share = (F.col("user_id") % FOLDERS).alias("folder"), F.pmod(F.xxhash64("user_id"), F.lit(4)).alias("share")
    dealt = lines.select("*", folder, share).repartition(_tasks(lines.sparkSession), "folder", "share").drop("user_id", "event_id", "share")
    dealt.write.mode(mode).option("maxRecordsPerFile", LOG_LINES).partitionBy("folder").json(root)


def delete_users(spark: SparkSession, root: str, modulus: int, rest: int) -> None:
    """Deletes the folders of the users with a remainder; the modulus divides `FOLDERS`."""
    files = Files(spark)
    for name in files.names(root):
        if name.startswith("folder=") and int(name.split("=")[1]) % modulus == rest:
            files.delete(f"{root}/{name}")


def _n(factor: int):
    return F.floor(F.col("value") * factor).cast("int")


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with and without usage, side chains, synthetic and unnamed models, and three kinds of working folders."""
    e = F.col("event_id")
    usage = F.struct(_n(10).alias("input_tokens"), _n(1).alias("output_tokens"), F.when(e % 2 == 0, _n(5)).alias("cache_creation_input_tokens"), _n(80).cast("string").alias("cache_read_input_tokens"))
    return _events(spark, sf_dir).select(
        "user_id",
        "event_id",
        F.when(e % 10 == 9, "user").otherwise("assistant").alias("type"),
        F.when(e % 3 == 0, F.concat(F.lit("/home/u/Proj"), (e % 20).cast("string"))).when(e % 3 == 1, F.concat(F.lit("C:\\w\\Win"), (e % 7).cast("string"))).otherwise("").alias("cwd"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"),
        F.when(e % 23 != 0, F.col("at")).alias("timestamp"),
        F.when(e % 5 == 0, e % 15 == 0).alias("isSidechain"),
        F.struct(F.when(e % 17 == 0, "<synthetic>").when(e % 19 != 0, F.concat(F.lit("claude-"), (e % 4).cast("string"))).alias("model"), F.when(e % 13 != 0, usage).alias("usage")).alias("message"),
    )


def ingest_claude_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{log_folder(spark)}/projects/Main"
    claude_lines(spark, sf_dir).drop("user_id", "event_id").write.json(folder)
    return read_claude(spark, [folder]).drop("source_file")


def ingest_codex_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per user: a header for most users, two for some, then a counter that rises, repeats and is missing at times."""
    events = _events(spark, sf_dir)
    upto = F.expr("sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding)")
    step = F.floor("value").cast("long")
    e = F.col("event_id")
    last = F.struct(F.when(e % 7 != 0, step).alias("total_tokens"), _n(1).alias("input_tokens"), (e % 9).cast("int").alias("output_tokens"), F.lit(2).alias("cached_input_tokens"))
    kind = "struct<cwd: string, type: string, info: struct<total_token_usage: struct<total_tokens: bigint>, last_token_usage: struct<total_tokens: bigint, input_tokens: int, output_tokens: int, cached_input_tokens: int>>>"
    counted = events.withColumn("_sum", upto).select(
        "user_id",
        F.lit("event_msg").alias("type"),
        F.concat("at", F.lit("."), F.lpad(e.cast("string"), 12, "0")).alias("timestamp"),
        F.struct(F.lit(None).cast("string").alias("cwd"), F.lit("token_count").alias("type"), F.when(e % 29 != 0, F.struct(F.struct(F.when(e % 11 != 0, F.col("_sum")).alias("total_tokens")).alias("total_token_usage"), last.alias("last_token_usage"))).alias("info")).cast(kind).alias("payload"),
    )
    heads = events.select("user_id").distinct().where("user_id % 4 <> 0")
    heads = heads.unionByName(heads.where("user_id % 10 = 1")).select(
        "user_id",
        F.lit("session_meta").alias("type"),
        F.lit("0").alias("timestamp"),
        F.struct(F.concat(F.lit("/home/u/Cdx"), (F.col("user_id") % 20).cast("string")).alias("cwd"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("info")).alias("payload"),
    ).withColumn("payload", F.struct("payload.cwd", "payload.type", F.lit(None).cast(counted.schema["payload"].dataType["info"].dataType).alias("info")))
    folder = f"{log_folder(spark)}/sessions"
    lines = counted.unionByName(heads)
    # dealt anew by what neither side of the union is dealt by: Spark takes the union as dealt by user, but may merge the tasks of each side differently
    lines.repartition(_tasks(spark), F.xxhash64("user_id")).sortWithinPartitions("user_id", "timestamp").write.partitionBy("user_id").option("ignoreNullFields", True).json(folder)
    rows = read_codex(spark, [folder])
    user = F.regexp_extract("source_file", "user_id=([0-9]+)", 1).cast("long").alias("user_id")
    return rows.select(user, "tool", "project", "date", "model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "total_tokens")


def ingest_gemini_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat a user, its messages gathered into an array. A file is one document: an array of the chats of some users."""
    e = F.col("event_id")
    tokens = F.struct(_n(10).alias("input"), F.when(e % 2 == 0, _n(1)).alias("output"), _n(8).alias("cached"), (e % 6 * 100).cast("int").alias("total"))
    said = F.struct(F.when(e % 23 != 0, F.col("at")).alias("timestamp"), F.concat(F.lit("gemini-"), (e % 4).cast("string")).alias("model"), F.when(e % 5 != 0, tokens).alias("tokens"))
    chats = _events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(said)).alias("messages")).select(
        "user_id", F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("sessionId"), "messages"
    )
    folder = f"{log_folder(spark)}/.gemini/tmp/MyGem/chats"
    some = F.floor(F.col("user_id") / CHATS)
    before = F.sum(F.size("messages")).over(Window.partitionBy("some").orderBy("user_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("messages")
    dealt = chats.withColumn("some", some).withColumn("part", F.floor(before / MESSAGES))
    documents = dealt.groupBy("some", "part").agg(F.to_json(F.collect_list(F.struct("sessionId", "messages"))).alias("value"))
    documents.repartition(_tasks(spark), "some", "part").select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return read_gemini(spark, [folder]).drop("source_file")


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache over folders of logs of some users each: filed once, then refreshed after some folders are gone and some have a second set of logs."""
    place = log_folder(spark)
    root, lines = f"{place}/logs", claude_lines(spark, sf_dir)
    write_claude_logs(lines, root)
    cache = TokenCache(spark, f"{place}/cache", [Tree("Claude Code", root, "*.json")])
    cache.load()
    delete_users(spark, root, 10, 1)
    write_claude_logs(lines.where("user_id % 10 = 3"), root, "append")
    return cache.load().groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"))


QUERIES = {"incremental_refresh": incremental_refresh, "ingest_claude_logs": ingest_claude_logs, "ingest_codex_logs": ingest_codex_logs, "ingest_gemini_logs": ingest_gemini_logs}

_PARTS = "CAST(floor(value * 10) AS INTEGER) AS i, CAST(floor(value) AS INTEGER) AS o, CAST(floor(value * 5) AS INTEGER) AS w, CAST(floor(value * 80) AS INTEGER) AS r"

ORACLE_SQL = {
    "incremental_refresh": f"""
WITH e AS (SELECT *, {_PARTS} FROM events), twice AS (SELECT 0 AS again UNION ALL SELECT 1)
SELECT 's' || CAST(user_id AS VARCHAR) AS session, CAST(count(*) AS BIGINT) AS turns, CAST(sum(i + o + r + CASE WHEN event_id % 2 = 0 THEN w ELSE 0 END) AS BIGINT) AS total_tokens
FROM e JOIN twice ON again = 0 OR user_id % 10 = 3
WHERE user_id % 10 != 1 AND event_id % 10 != 9 AND NOT (event_id % 5 = 0 AND event_id % 15 = 0) AND event_id % 17 != 0 AND event_id % 19 != 0 AND event_id % 13 != 0 AND event_id % 23 != 0
GROUP BY user_id""",
    "ingest_claude_logs": f"""
WITH e AS (SELECT *, {_PARTS} FROM events), c AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN w ELSE 0 END AS cw,
    CASE event_id % 3 WHEN 0 THEN 'proj' || CAST(event_id % 20 AS VARCHAR) WHEN 1 THEN 'win' || CAST(event_id % 7 AS VARCHAR) ELSE 'main' END AS project
  FROM e WHERE event_id % 10 != 9 AND NOT (event_id % 5 = 0 AND event_id % 15 = 0) AND event_id % 17 != 0 AND event_id % 19 != 0 AND event_id % 13 != 0 AND event_id % 23 != 0)
SELECT 'Claude Code' AS tool, project, 's' || CAST(user_id AS VARCHAR) AS session, substr(CAST(ts AS VARCHAR), 1, 10) AS date, 'claude-' || CAST(event_id % 4 AS VARCHAR) AS model,
  i AS input_tokens, o AS output_tokens, cw AS cache_write_tokens, r AS cache_read_tokens, CAST(i AS BIGINT) + o + cw + r AS total_tokens FROM c""",
    "ingest_codex_logs": """
WITH s AS (SELECT *, CAST(floor(value) AS BIGINT) AS step, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events),
t AS (SELECT *, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s),
r AS (SELECT *, CASE WHEN event_id % 11 != 0 THEN total END AS running, CASE WHEN event_id % 7 != 0 THEN step END AS last FROM t WHERE event_id % 29 != 0),
p AS (SELECT *, lag(running) OVER (PARTITION BY user_id ORDER BY stamp, event_id) AS prev FROM r),
d AS (SELECT *, CASE WHEN last > 0 THEN last WHEN running IS NOT NULL AND prev IS NOT NULL THEN running - prev ELSE 0 END AS delta FROM p),
h AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 != 0), hh AS (SELECT user_id FROM h UNION ALL SELECT user_id FROM h WHERE user_id % 10 = 1)
SELECT d.user_id, 'Codex' AS tool, CASE WHEN hh.user_id IS NULL THEN '' ELSE 'cdx' || CAST(d.user_id % 20 AS VARCHAR) END AS project, substr(stamp, 1, 10) AS date, '' AS model,
  CAST(floor(value) AS INTEGER) AS input_tokens, CAST(event_id % 9 AS INTEGER) AS output_tokens, 0 AS cache_write_tokens, 2 AS cache_read_tokens, delta AS total_tokens
FROM d LEFT JOIN hh ON hh.user_id = d.user_id WHERE (running IS NULL OR running != coalesce(prev, -1)) AND delta > 0""",
    "ingest_gemini_logs": f"""
WITH e AS (SELECT *, {_PARTS}, CAST(floor(value * 8) AS INTEGER) AS c FROM events)
SELECT 'Gemini' AS tool, 'mygem' AS project, 'g' || CAST(user_id AS VARCHAR) AS session, CASE WHEN event_id % 23 != 0 THEN substr(CAST(ts AS VARCHAR), 1, 10) END AS date,
  'gemini-' || CAST(event_id % 4 AS VARCHAR) AS model, i AS input_tokens, CASE WHEN event_id % 2 = 0 THEN o ELSE 0 END AS output_tokens, 0 AS cache_write_tokens, c AS cache_read_tokens,
  CAST(event_id % 6 * 100 AS BIGINT) AS total_tokens FROM e WHERE event_id % 5 != 0 AND event_id % 6 != 0""",
}
