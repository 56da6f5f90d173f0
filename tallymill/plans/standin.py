"""A legal `tokens` table made from the driver's `events`, with the same projection as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.sources import schemas

#: Models by event number modulo four.
CLAUDE_MODELS = ("claude-sonnet-4", "claude-opus-4", "claude-haiku-4", "claude-sonnet-4-5")
GEMINI_MODELS = ("gemini-2.5-pro", "gemini-2.5-flash", "gemini-3.1-pro", "gemini-2.5-flash-lite")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    kind, which = F.col("event_id") % 3, F.col("event_id") % 4
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (which + 1).cast("int"))
    times = lambda n: F.floor(F.col("value") * n).cast("int")
    rows = events.select(
        F.when(kind == 0, "Claude Code").when(kind == 1, "Codex").otherwise("Gemini").alias("tool"),
        F.concat(F.lit("proj"), (F.col("user_id") % 20).cast("string")).alias("project"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("date"),
        F.when(kind == 0, pick(CLAUDE_MODELS)).when(kind == 1, "").otherwise(pick(GEMINI_MODELS)).alias("model"),
        times(10).alias("input_tokens"),
        times(1).alias("output_tokens"),
        F.when(kind == 0, times(5)).otherwise(0).alias("cache_write_tokens"),
        times(80).alias("cache_read_tokens"),
        F.concat(F.lit("/logs/"), (F.col("event_id") % 50).cast("string"), F.lit(".jsonl")).alias("source_file"),
    )
    parts = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
    return rows.withColumn("total_tokens", sum((F.col(c).cast("long") for c in parts), F.lit(0).cast("long"))).select(schemas.TOKENS.fieldNames())


def _pick(names: tuple[str, ...]) -> str:
    return "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: Common table expressions `e` and `tokens`; every query over the stand-in begins with them.
TOKENS_SQL = f"""
WITH e AS (
  SELECT event_id % 3 AS k, event_id, ts, user_id, CAST(floor(value * 10) AS INTEGER) AS i, CAST(floor(value * 1) AS INTEGER) AS o,
    CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 5) AS INTEGER) ELSE 0 END AS w, CAST(floor(value * 80) AS INTEGER) AS r FROM events
), tokens AS (
  SELECT CASE k WHEN 0 THEN 'Claude Code' WHEN 1 THEN 'Codex' ELSE 'Gemini' END AS tool, 'proj' || CAST(user_id % 20 AS VARCHAR) AS project,
    's' || CAST(user_id AS VARCHAR) AS session, substr(CAST(ts AS VARCHAR), 1, 10) AS date,
    CASE k WHEN 0 THEN {_pick(CLAUDE_MODELS)} WHEN 1 THEN '' ELSE {_pick(GEMINI_MODELS)} END AS model,
    i AS input_tokens, o AS output_tokens, w AS cache_write_tokens, r AS cache_read_tokens,
    CAST(i AS BIGINT) + o + w + r AS total_tokens, '/logs/' || CAST(event_id % 50 AS VARCHAR) || '.jsonl' AS source_file FROM e
)"""
