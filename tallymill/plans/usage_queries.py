"""Named queries over the stand-in `tokens`, and what DuckDB should answer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions.formatting import fmt, fmtcost
from tallymill.functions.pricing import cost_numerator, total_cost
from tallymill.operators import filters
from tallymill.operators.rollup import levels
from tallymill.plans import charts, reports
from tallymill.plans.standin import TOKENS_SQL, tokens
from tallymill.sources import session_logs

#: A fixed day, so that relative dates give the same rows every day.
TODAY = date(2024, 3, 1)

COST = """CASE WHEN tool = 'Codex' THEN input_tokens * 1.25 + cache_write_tokens * 1.25 + cache_read_tokens * 0.125 + output_tokens * 10.0
 WHEN tool = 'Gemini' AND model LIKE '%flash%' THEN input_tokens * 0.15 + cache_read_tokens * 0.0375 + output_tokens * 0.60
 WHEN tool = 'Gemini' AND model LIKE '%2.5%pro%' THEN input_tokens * 1.25 + cache_read_tokens * 0.125 + output_tokens * 10.0
 WHEN tool = 'Gemini' THEN input_tokens * 2.0 + cache_read_tokens * 0.50 + output_tokens * 12.0
 WHEN model LIKE '%opus%' THEN input_tokens * 5.0 + cache_write_tokens * 6.25 + cache_read_tokens * 0.50 + output_tokens * 25.0
 WHEN model LIKE '%haiku%' THEN input_tokens * 1.0 + cache_write_tokens * 1.25 + cache_read_tokens * 0.10 + output_tokens * 5.0
 ELSE input_tokens * 3.0 + cache_write_tokens * 3.75 + cache_read_tokens * 0.30 + output_tokens * 15.0 END"""
SUM_COST = f"CAST(sum(CAST({COST} AS DECIMAL(24,4))) AS DOUBLE) / 1e6"


def fmt_sql(n: str) -> str:
    return (
        f"lpad(CASE WHEN {n} >= 1e9 THEN printf('%.1fB', ({n}) / 1e9) WHEN {n} >= 1e6 THEN printf('%.1fM', ({n}) / 1e6) "
        f"WHEN {n} >= 1e3 THEN printf('%.1fk', ({n}) / 1e3) ELSE CAST({n} AS VARCHAR) END, 7, ' ')"
    )


def fmtcost_sql(n: str) -> str:
    return f"CASE WHEN {n} < 10 THEN printf('$%.2f', {n}) WHEN {n} < 100 THEN printf('$%.1f', {n}) ELSE printf('$%.0f', {n}) END"


SUMMARY = f"""CAST(count(*) AS INTEGER) AS turns, {fmt_sql("sum(total_tokens)")} AS total,
 {fmt_sql("(sum(total_tokens) - 0.9 * sum(cache_read_tokens))")} AS billable, {fmt_sql("sum(output_tokens)")} AS output,
 lpad(printf('%.0f%%', 100.0 * sum(cache_read_tokens) / greatest(sum(total_tokens) - sum(output_tokens), 1)), 4, ' ') AS cache,
 {fmtcost_sql(SUM_COST)} AS api_cost"""


def _report_sql(keys: str, tail: str = "", detail: str = "", order: str = "", source: str = "tokens") -> str:
    """Three levels as a union; `keys` are the detail's columns beside the tool; `source` is what stands for the tokens."""
    names = [k.strip() for k in keys.split(",")]
    stars = ", ".join(f"'*' AS {k}" for k in names)
    body = f"""SELECT {stars}, '*' AS tool, {SUMMARY}{tail}, sum(total_tokens) AS _sort FROM {source}
 UNION ALL SELECT {stars}, tool, {SUMMARY}{tail}, sum(total_tokens) FROM {source} GROUP BY tool
 UNION ALL SELECT {keys}, tool, {SUMMARY}{tail}, sum(total_tokens) FROM {source} {detail} GROUP BY {keys}, tool"""
    return f"{TOKENS_SQL}\nSELECT * EXCLUDE (_sort) FROM ({body}) {order}"


SEEN = ", min(date) AS first_seen, max(date) AS last_seen"
FIRST = ", min(date) AS date"


def _order(key: str, rest: str, limit: int) -> str:
    return f"ORDER BY CASE WHEN {key} = '*' AND tool = '*' THEN 0 WHEN {key} = '*' THEN 1 ELSE 2 END, {rest} LIMIT {limit}"


def _over(f):
    return lambda spark, sf_dir: f(tokens(spark, sf_dir))


def cost_per_row(t: DataFrame) -> DataFrame:
    per_row = (cost_numerator().cast("double") / 1e6).alias("cost")
    return t.select("tool", "model", "session", "date", "input_tokens", per_row)


def cost_by_model_family(t: DataFrame) -> DataFrame:
    family = F.regexp_extract("model", "(opus|haiku|sonnet|flash|pro)", 1).alias("family")
    return t.groupBy("tool", family).agg(total_cost().alias("cost"), F.sum("total_tokens").alias("total_tokens"))


def cache_hit_ratio(t: DataFrame) -> DataFrame:
    read, prompt = F.sum("cache_read_tokens"), F.sum("total_tokens") - F.sum("output_tokens")
    return t.groupBy("tool", "project").agg(F.round(F.lit(100.0) * read / F.greatest(prompt, F.lit(1)), 6).alias("percent"))


def billable_tokens(t: DataFrame) -> DataFrame:
    billable = F.sum("total_tokens") - F.sum("cache_read_tokens") * F.lit("0.9").cast("decimal(2,1)")
    return t.groupBy("project").agg(F.round(billable).cast("long").alias("billable"))


#: What the events' numbers are multiplied by, so that they cross every boundary of the formats.
FACTORS = (1, 10, 1000, 10000, 1000000, 100000000, 10000000000, -1)


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of all sizes made from the events: value in hundredths times a factor by event."""
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in FACTORS]), (F.col("event_id") % len(FACTORS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.floor(F.col("value") * 100) * factor).alias("n"))


def fmt_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir).select("event_id", "n", fmt(F.col("n")).alias("text"))


def fmtcost_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("n").cast("double") / 1000).alias("n")
    return _spread(spark, sf_dir).select("event_id", n).select("event_id", "n", fmtcost(F.col("n")).alias("text"))


def _some_odd(t: DataFrame) -> DataFrame:
    """Tokens some of whose dates are missing, written otherwise or no dates at all."""
    n = F.col("input_tokens") % 11
    odd = F.when(n == 3, F.replace("date", F.lit("-"), F.lit("/"))).when(n == 5, F.lit(None)).when((n == 7) & (F.col("tool") == "Codex"), F.lit("2024-02-31"))
    return t.withColumn("date", F.when((n == 9) & (F.col("project") == "proj3"), F.lit("unknown")).otherwise(F.when((n == 3) | (n == 5) | ((n == 7) & (F.col("tool") == "Codex")), odd).otherwise(F.col("date"))))


def codex_delta_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values as a running counter that repeats now and then and sometimes lacks a reading."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.floor("value")).cast("long")
    running = F.sum(step).over(upto)
    entries = events.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("long")).otherwise(running).alias("running"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("long")).otherwise(step).alias("last"),
    )
    return session_logs.counter_deltas(entries, "user_id", ("ts", "event_id"), "running", "last").select("user_id", "event_id", F.col("delta").alias("total_tokens"))


def codex_left_join_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a file count once for each of its headers; a file without one keeps its own name."""
    t = tokens(spark, sf_dir).where("tool = 'Codex'")
    headers = spark.range(40).selectExpr("concat('/logs/', id % 30, '.jsonl') AS source_file", "concat('head', id) AS header")
    stem = F.regexp_extract("source_file", r"([^/]+)[.]jsonl", 1)
    joined = session_logs.with_headers(t, headers).select(F.coalesce("header", stem).alias("project"), "total_tokens")
    return joined.groupBy("project").agg(F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"))


def project_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return pages.select("page_id", session_logs.project_of(F.col("url"), host).alias("project"))


def hashed_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = F.when(F.col("page_id") % 2 == 0, F.sha2(F.col("url").cast("binary"), 256)).otherwise(F.concat(F.lit("Site"), F.col("page_id").cast("string")))
    return pages.select("page_id", session_logs.hashed_project(folder).alias("project"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def explode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    chats = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("messages"))
    said = chats.select("conv_id", F.explode("messages").alias("m"))
    return said.groupBy("conv_id", "m.role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("m.text")).alias("chars"))


def model_not_synthetic(t: DataFrame) -> DataFrame:
    model = F.when(F.col("model") == "claude-haiku-4", "<synthetic>").when(F.col("model") != "", F.col("model"))
    return t.withColumn("model", model).where(session_logs.named_model(F.col("model"))).groupBy("model").agg(F.count(F.lit(1)).alias("turns"))


def since_null_dates(t: DataFrame) -> DataFrame:
    undated = t.withColumn("date", F.when(F.col("tool") != "Gemini", F.col("date")))
    return filters.since(undated, "30d", TODAY).groupBy("tool", "date").agg(F.count(F.lit(1)).alias("turns"))


def _daily(t: DataFrame) -> DataFrame:
    return t.groupBy("tool", "date").agg(F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"))


def rollup_levels(t: DataFrame) -> DataFrame:
    return levels(t, ["project"]).select("tool", "project", "_turns", "_total", "_output", F.col("_first").alias("first_seen")).toDF(
        "tool", "project", "turns", "total_tokens", "output_tokens", "first_seen"
    )


QUERIES = {
    "usage_by_project": _over(lambda t: reports.by_project(t, None)),
    "usage_by_date": _over(lambda t: reports.by_date(t, None)),
    "usage_by_model": _over(reports.by_model),
    "usage_by_session": _over(lambda t: reports.by_session(t, None)),
    "usage_by_project_limit": _over(lambda t: reports.by_project(t, 20)),
    "usage_by_date_limit": _over(lambda t: reports.by_date(t, 20)),
    "usage_by_session_limit": _over(lambda t: reports.by_session(t, 50)),
    "usage_empty_input": _over(lambda t: reports.by_project(t.where("tool = 'none'"), None)),
    "usage_rollup_levels": _over(rollup_levels),
    "cost_per_row": _over(cost_per_row),
    "cost_by_tool": _over(lambda t: t.groupBy("tool").agg(total_cost().alias("cost"))),
    "cost_by_model_family": _over(cost_by_model_family),
    "cost_total": _over(lambda t: t.agg(total_cost().alias("cost"))),
    "cache_hit_ratio": _over(cache_hit_ratio),
    "billable_tokens": _over(billable_tokens),
    "usage_odd_dates_by_project": _over(lambda t: reports.by_project(_some_odd(t), None)),
    "usage_odd_dates_by_session": _over(lambda t: reports.by_session(_some_odd(t), None)),
    "fmt_boundaries": fmt_boundaries,
    "fmtcost_boundaries": fmtcost_boundaries,
    "chart_moving_cost": _over(charts.moving_costs),
    "chart_totals": _over(charts.totals),
    "chart_tool_costs": _over(charts.tool_costs),
    "chart_date_count": _over(charts.date_count),
    "chart_top_projects": _over(charts.top_projects),
    "chart_daily_cost": _over(charts.daily_costs),
    "environment_impact": _over(charts.footprint),
    "since_days": _over(lambda t: _daily(filters.since(t, "7d", TODAY))),
    "since_hours": _over(lambda t: _daily(filters.since(t, "36h", TODAY))),
    "since_literal": _over(lambda t: _daily(filters.since(t, "2024-01-20", TODAY))),
    "since_null_dates": _over(since_null_dates),
    "tool_filter": _over(lambda t: _daily(filters.of_tool(t, "Gemini"))),
    "codex_delta_lag": codex_delta_lag,
    "codex_left_join_fanout": codex_left_join_fanout,
    "claude_project_from_path": project_from_path,
    "gemini_hash_project": hashed_project,
    "json_field_extract": json_field,
    "explode_messages": explode_messages,
    "model_not_synthetic_3vl": _over(model_not_synthetic),
}

_ODD = """(SELECT * REPLACE (CASE WHEN input_tokens % 11 = 9 AND project = 'proj3' THEN 'unknown' WHEN input_tokens % 11 = 3 THEN replace(date, '-', '/') WHEN input_tokens % 11 = 5 THEN NULL
 WHEN input_tokens % 11 = 7 AND tool = 'Codex' THEN '2024-02-31' ELSE date END AS date) FROM tokens) AS t"""
_SPREAD = f"SELECT event_id, CAST(floor(value * 100) AS BIGINT) * [{', '.join(map(str, FACTORS))}][event_id % {len(FACTORS)} + 1] AS n FROM events"
_DAILY = "SELECT tool, date, CAST(count(*) AS BIGINT) AS turns, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM tokens"
_BILLABLE = "CAST(round(sum(total_tokens) - 0.9 * sum(cache_read_tokens)) AS BIGINT)"
_STAR = "SELECT '*' AS project, '*' AS tool"

ORACLE_SQL = {
    "usage_by_project": _report_sql("project", SEEN),
    "usage_by_date": _report_sql("date"),
    "usage_by_model": _report_sql("model", detail="WHERE model != ''"),
    "usage_by_session": _report_sql("project, session", FIRST),
    "usage_by_project_limit": _report_sql("project", SEEN, order=_order("project", "_sort DESC, project, tool", 20)),
    "usage_by_date_limit": _report_sql("date", order=_order("date", "date DESC, _sort DESC, tool", 20)),
    "usage_by_session_limit": _report_sql("project, session", FIRST, order=_order("project", "_sort DESC, project, session, tool", 50)),
    "usage_empty_input": f"{TOKENS_SQL} {_STAR}, {SUMMARY}{SEEN} FROM tokens WHERE tool = 'none'",
    "usage_rollup_levels": f"""{TOKENS_SQL} SELECT CASE WHEN grouping(tool) = 1 THEN '*' ELSE tool END AS tool,
 CASE WHEN grouping(project) = 1 THEN '*' ELSE project END AS project, CAST(count(*) AS BIGINT) AS turns, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(date) AS first_seen FROM tokens GROUP BY GROUPING SETS ((), (tool), (tool, project))""",
    "cost_per_row": f"{TOKENS_SQL} SELECT tool, model, session, date, input_tokens, CAST(CAST({COST} AS DECIMAL(24,4)) AS DOUBLE) / 1e6 AS cost FROM tokens",
    "cost_by_tool": f"{TOKENS_SQL} SELECT tool, {SUM_COST} AS cost FROM tokens GROUP BY tool",
    "cost_by_model_family": f"""{TOKENS_SQL} SELECT tool, regexp_extract(model, '(opus|haiku|sonnet|flash|pro)', 1) AS family, {SUM_COST} AS cost,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM tokens GROUP BY 1, 2""",
    "cost_total": f"{TOKENS_SQL} SELECT {SUM_COST} AS cost FROM tokens",
    "cache_hit_ratio": f"""{TOKENS_SQL} SELECT tool, project,
 round(100.0 * sum(cache_read_tokens) / greatest(sum(total_tokens) - sum(output_tokens), 1), 6) AS percent FROM tokens GROUP BY tool, project""",
    "billable_tokens": f"{TOKENS_SQL} SELECT project, {_BILLABLE} AS billable FROM tokens GROUP BY project",
    "usage_odd_dates_by_project": _report_sql("project", SEEN, source=_ODD),
    "usage_odd_dates_by_session": _report_sql("project, session", FIRST, source=_ODD),
    "fmt_boundaries": f"SELECT event_id, n, {fmt_sql('n')} AS text FROM ({_SPREAD})",
    "fmtcost_boundaries": f"SELECT event_id, n, {fmtcost_sql('n')} AS text FROM (SELECT event_id, CAST(n AS DOUBLE) / 1000 AS n FROM ({_SPREAD}))",
    "chart_moving_cost": f"""{TOKENS_SQL}, d AS (SELECT tool, CAST(date AS DATE) AS day, sum(CAST({COST} AS DECIMAL(24,4))) AS c FROM tokens GROUP BY tool, date)
 SELECT tool, CAST(day AS VARCHAR) AS date, CAST(c AS DOUBLE) / 1e6 AS cost,
 CAST(sum(c) OVER (PARTITION BY tool ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) / 1e6 AS cost_7d FROM d""",
    "chart_totals": f"""{TOKENS_SQL} SELECT CAST(sum(total_tokens) AS BIGINT) AS total, {_BILLABLE} AS billable,
 CAST(count(DISTINCT tool) AS INTEGER) AS n_tools, CAST(count(DISTINCT project) AS INTEGER) AS n_projects, {SUM_COST} AS cost FROM tokens""",
    "chart_tool_costs": f"{TOKENS_SQL} SELECT tool, {SUM_COST} AS cost FROM tokens GROUP BY tool",
    "chart_date_count": f"{TOKENS_SQL} SELECT CAST(count(DISTINCT date) AS INTEGER) AS n FROM tokens",
    "chart_top_projects": f"""{TOKENS_SQL}, top AS (SELECT project, {SUM_COST} AS c FROM tokens GROUP BY project ORDER BY c DESC, project LIMIT 10)
 SELECT project, tool, {SUM_COST} AS cost FROM tokens WHERE project IN (SELECT project FROM top) GROUP BY project, tool""",
    "chart_daily_cost": f"{TOKENS_SQL} SELECT date, tool, {SUM_COST} AS cost FROM tokens GROUP BY date, tool",
    "environment_impact": f"""{TOKENS_SQL} SELECT billable, billable * 0.6::DOUBLE / 1e6 AS kwh, billable * 1.0::DOUBLE / 1e6 AS liters,
 billable * 0.09::DOUBLE / 1e6 AS co2_kg FROM (SELECT {_BILLABLE} AS billable FROM tokens)""",
    "since_days": f"{TOKENS_SQL} {_DAILY} WHERE NOT coalesce(date < CAST(CAST(DATE '2024-03-01' - INTERVAL 7 DAY AS DATE) AS VARCHAR), false) GROUP BY tool, date",
    "since_hours": f"{TOKENS_SQL} {_DAILY} WHERE NOT coalesce(date < CAST(CAST(DATE '2024-03-01' - INTERVAL 36 HOUR AS DATE) AS VARCHAR), false) GROUP BY tool, date",
    "since_literal": f"{TOKENS_SQL} {_DAILY} WHERE NOT coalesce(date < '2024-01-20', false) GROUP BY tool, date",
    "since_null_dates": f"""{TOKENS_SQL}, u AS (SELECT tool, CASE WHEN tool != 'Gemini' THEN date END AS date FROM tokens)
 SELECT tool, date, CAST(count(*) AS BIGINT) AS turns FROM u WHERE date IS NULL OR date >= CAST(CAST(DATE '2024-03-01' - INTERVAL 30 DAY AS DATE) AS VARCHAR) GROUP BY tool, date""",
    "tool_filter": f"{TOKENS_SQL} {_DAILY} WHERE tool = 'Gemini' GROUP BY tool, date",
    "codex_delta_lag": """
WITH s AS (SELECT user_id, ts, event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(value) END AS BIGINT) AS step FROM events
), r AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE step END AS last,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS running FROM s
), p AS (SELECT *, lag(running) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM r
), d AS (SELECT *, CASE WHEN last > 0 THEN last WHEN running IS NOT NULL AND prev IS NOT NULL THEN running - prev ELSE 0 END AS delta FROM p)
SELECT user_id, event_id, CAST(delta AS BIGINT) AS total_tokens FROM d WHERE (running IS NULL OR running != coalesce(prev, -1)) AND delta > 0""",
    "codex_left_join_fanout": f"""{TOKENS_SQL}, h AS (SELECT '/logs/' || CAST(range % 30 AS VARCHAR) || '.jsonl' AS source_file, 'head' || CAST(range AS VARCHAR) AS header FROM range(40))
SELECT coalesce(header, regexp_extract(t.source_file, '([^/]+)[.]jsonl', 1)) AS project, CAST(count(*) AS BIGINT) AS turns, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM tokens t LEFT JOIN h ON t.source_file = h.source_file WHERE tool = 'Codex' GROUP BY 1""",
    "claude_project_from_path": "SELECT page_id, lower(coalesce(nullif(split_part(url, '/', -1), ''), regexp_extract(url, '://([^/]+)', 1))) AS project FROM pages",
    "gemini_hash_project": """WITH f AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN sha256(url) ELSE 'Site' || CAST(page_id AS VARCHAR) END AS folder FROM pages)
SELECT page_id, CASE WHEN regexp_matches(folder, '^[0-9a-f]{64}$') THEN folder[:8] ELSE lower(folder) END AS project FROM f""",
    "json_field_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "explode_messages": "SELECT conv_id, role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id, role",
    "model_not_synthetic_3vl": f"{TOKENS_SQL} SELECT model, CAST(count(*) AS BIGINT) AS turns FROM (SELECT nullif(model, '') AS model FROM tokens) WHERE model != 'claude-haiku-4' GROUP BY model",
}
