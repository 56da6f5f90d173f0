"""Queries of what the library adds for large inputs: mergeable summaries, range and as-of joins without hot tasks, JSON without a schema,
counts of bad records, and refreshes that rewrite nothing.

Estimates are held against exact numbers here, and come out as whether they keep their bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import sketches
from tallymill.operators.asof import asof_join_sliced
from tallymill.operators.range_join import range_join
from tallymill.plans.log_queries import claude_lines, delete_users, log_folder, write_claude_logs
from tallymill.plans.standin import TOKENS_SQL, tokens
from tallymill.sources.cache import TokenCache, Tree
from tallymill.sources.dynamic import key_counts, unknown_keys
from tallymill.sources.session_logs import Tally, read_claude
from tallymill.sources.storage import Files, stored


def _daily(t: DataFrame) -> DataFrame:
    """Summaries by tool and day, stored as a cache stores them; what follows reads these alone."""
    return stored(sketches.summarized(t), "daily-summaries")


def sketch_distinct_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each month and tool, by merging the days' sketches: exact number, and whether the estimate is within four deviations."""
    t = tokens(spark, sf_dir)
    month = F.substring("date", 1, 7).alias("month")
    found = sketches.estimates(sketches.merged(_daily(t).withColumn("month", month), ["tool", "month"]), [])
    exact = t.groupBy("tool", month).agg(F.countDistinct("session").alias("exact"))
    off = F.abs(F.col("sessions") - F.col("exact")) / F.col("exact")
    return found.join(exact, ["tool", "month"]).select("tool", "month", "turns", "exact", (off <= 4 * sketches.DISTINCT_ERROR).alias("within"))


def sketch_turn_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90 and 99 % of turn sizes by tool, by merging the days' sketches: whether the true ranks of the estimates are within twice the
    sketch's error."""
    t, quantiles = tokens(spark, sf_dir), (0.5, 0.9, 0.99)
    found = sketches.estimates(sketches.merged(_daily(t), ["tool"]), quantiles).drop("turns", "total_tokens", "sessions")
    # one row a tool goes to the rows
    rows = t.select("tool", "total_tokens").join(F.broadcast(found), "tool")
    size, off = F.col("total_tokens"), []
    for q in quantiles:
        name = f"p{q * 100:g}"
        below, upto = (F.avg(c.cast("double")) for c in (size < F.col(name), size <= F.col(name)))
        bound = 2 * sketches.RANK_ERROR
        off.append(((below <= q + bound) & (upto >= q - bound)).alias(f"{name}_within"))
    return rows.groupBy("tool").agg(F.count(F.lit(1)).alias("turns"), *off)


def join_range_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the orders that are open at its second; orders stay open for up to two hours, a few for a month."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") * 1037389 % (2400 * 86400)).alias("at"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    opened = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000).cast("long") - 694224000 + F.col("o_orderkey") * 104729 % 86400
    length = F.when(F.col("o_orderkey") % 5000 == 0, 30 * 86400).otherwise(F.col("o_orderkey") % 7200)
    spans = orders.select("o_orderkey", opened.alias("opened")).withColumn("closed", F.col("opened") + length)
    return range_join(events, spans, "at", "opened", "closed", unit=60).select("event_id", "o_orderkey")


def asof_sliced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order of anyone with the same remainder up to that day: three keys, so that one has a third of all rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("k"), (F.col("event_id") % 2400).alias("day"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    dated = orders.select((F.col("o_custkey") % 3).alias("k"), at.alias("at"), "o_orderkey")
    return asof_join_sliced(events, dated, "k", "day", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


def variant_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' properties, wrapped as a log's usage with fields that no reader names, by path and kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    usage = F.concat(
        F.lit('{"input_tokens": 1, "event": '), F.col("props"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "tiers": [{"name": "'), F.col("event_type"), F.lit('"}, '), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.lit("")),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return key_counts(events.select("event_type", usage.alias("usage")), "usage", ["event_type"])


def variant_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties' keys that are not among the known ones, here any but `j`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "props")
    return unknown_keys(events, "props", ["$.j"], ["event_type"])


def variant_explode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties' fields as rows, by Spark's own table function."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = "SELECT event_id, f.key, variant_get(f.value, '$', 'bigint') AS value FROM {events}, LATERAL variant_explode(parse_json(props)) AS f"
    return spark.sql(text, events=events)


def log_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made from the events, some lines of which are cut off and some too long: what the reader counts beside the rows it gives."""
    lines = claude_lines(spark, sf_dir).select(F.to_json(F.struct("type", "cwd", "sessionId", "timestamp", "isSidechain", "message")).alias("value"), "event_id")
    cut = F.when(F.col("event_id") % 31 == 0, F.substring("value", F.lit(1), F.length("value") - 2)).when(F.col("event_id") % 37 == 0, F.concat("value", F.repeat(F.lit(" "), F.lit(5000)))).otherwise(F.col("value"))
    folder = f"{log_folder(spark)}/projects/Main"
    lines.select(cut.alias("value")).write.text(folder)
    tally = Tally()
    with tally.gathering(spark):
        kept = read_claude(spark, [folder], tally, longest=5000).agg(F.count(F.lit(1)).alias("rows"), F.sum("total_tokens").alias("total_tokens")).first()
    counts = tally.counts()["Claude Code"]
    row = (*(int(counts[c]) for c in ("read", "malformed", "too_long", "kept")), kept["rows"], kept["total_tokens"])
    return spark.createDataFrame([row], "read long, malformed long, too_long long, kept long, rows long, total_tokens long")


def cache_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after logs of some users were deleted: what it gives by session, its stored summaries, and that no row was written."""
    place = log_folder(spark)
    root, lines = f"{place}/logs", claude_lines(spark, sf_dir)
    write_claude_logs(lines, root)
    cache, files = TokenCache(spark, f"{place}/cache", [Tree("Claude Code", root, "*.json")]), Files(spark)
    cache.load()
    before = set(files.names(cache.folder))
    delete_users(spark, root, 50, 1)
    rows = cache.load()
    added = [n for n in files.names(cache.folder) if n not in before and not n.startswith("manifest-")]
    by_session = rows.groupBy("date").agg(F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"))
    summed = sketches.merged(cache.summaries(), ["date"]).select("date", F.col("turns").alias("summary_turns"), F.col("total_tokens").alias("summary_tokens"))
    return by_session.join(summed, "date").withColumn("folders_written", F.lit(len(added)))


QUERIES = {
    "asof_sliced_order": asof_sliced_order,
    "cache_deletions": cache_deletions,
    "join_range_orders": join_range_orders,
    "log_accounting": log_accounting,
    "sketch_distinct_sessions": sketch_distinct_sessions,
    "sketch_turn_quantiles": sketch_turn_quantiles,
    "variant_explode_fields": variant_explode_fields,
    "variant_key_counts": variant_key_counts,
    "variant_unknown_keys": variant_unknown_keys,
}

_NAMED = "event_id % 10 != 9 AND NOT (event_id % 5 = 0 AND event_id % 15 = 0) AND event_id % 17 != 0 AND event_id % 19 != 0 AND event_id % 13 != 0 AND event_id % 23 != 0"
_TOTAL = "CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) + CAST(floor(value * 80) AS BIGINT) + CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 5) AS BIGINT) ELSE 0 END"

ORACLE_SQL = {
    "asof_sliced_order": """SELECT event_id, arg_max(o_orderkey, {'d': placed, 'k': o_orderkey}) AS o_orderkey FROM (SELECT event_id, user_id % 3 AS k, event_id % 2400 AS day FROM events) e
LEFT JOIN (SELECT o_custkey % 3 AS k, max(o_orderkey) AS o_orderkey, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS placed FROM orders GROUP BY 1, 3) o ON o.k = e.k AND placed <= day GROUP BY event_id""",
    "cache_deletions": f"""SELECT substr(CAST(ts AS VARCHAR), 1, 10) AS date, CAST(count(*) AS BIGINT) AS turns, CAST(sum({_TOTAL}) AS BIGINT) AS total_tokens,
 CAST(count(*) AS BIGINT) AS summary_turns, CAST(sum({_TOTAL}) AS BIGINT) AS summary_tokens, 0 AS folders_written FROM events WHERE user_id % 50 != 1 AND {_NAMED} GROUP BY 1""",
    "join_range_orders": """WITH e AS (SELECT event_id, event_id * 1037389 % (2400 * 86400) AS moment FROM events),
o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - 694224000 + o_orderkey * 104729 % 86400 AS opened, CASE WHEN o_orderkey % 5000 = 0 THEN 30 * 86400 ELSE o_orderkey % 7200 END AS length FROM orders)
SELECT event_id, o_orderkey FROM e JOIN o ON moment >= opened AND moment <= opened + length""",
    "log_accounting": f"""WITH e AS (SELECT *, event_id % 31 != 0 AND event_id % 37 != 0 AND {_NAMED} AS good FROM events)
SELECT CAST(count(*) AS BIGINT) AS read, CAST(count(*) FILTER (event_id % 31 = 0) AS BIGINT) AS malformed, CAST(count(*) FILTER (event_id % 31 != 0 AND event_id % 37 = 0) AS BIGINT) AS too_long,
 CAST(count(*) FILTER (good) AS BIGINT) AS kept, CAST(count(*) FILTER (good) AS BIGINT) AS rows, CAST(sum({_TOTAL}) FILTER (good) AS BIGINT) AS total_tokens FROM e""",
    "sketch_distinct_sessions": f"""{TOKENS_SQL} SELECT tool, substr(date, 1, 7) AS month, CAST(count(*) AS BIGINT) AS turns, CAST(count(DISTINCT session) AS BIGINT) AS exact, true AS within FROM tokens GROUP BY 1, 2""",
    "sketch_turn_quantiles": f"{TOKENS_SQL} SELECT tool, CAST(count(*) AS BIGINT) AS turns, true AS p50_within, true AS p90_within, true AS p99_within FROM tokens GROUP BY tool",
    "variant_explode_fields": "SELECT event_id, unnest(json_keys(props)) AS key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value FROM events",
    "variant_key_counts": """WITH e AS (SELECT *, event_id % 7 != 0 AS whole, event_id % 3 = 0 AS listed FROM events),
r AS (SELECT event_type, unnest(CASE WHEN NOT whole THEN [{'path': NULL, 'kind': NULL}] ELSE list_concat(
  [{'path': '$', 'kind': 'OBJECT'}, {'path': '$.input_tokens', 'kind': 'BIGINT'}, {'path': '$.event', 'kind': 'OBJECT'}, {'path': '$.event.k', 'kind': 'BIGINT'}],
  CASE WHEN listed THEN [{'path': '$.tiers', 'kind': 'ARRAY'}, {'path': '$.tiers[]', 'kind': 'OBJECT'}, {'path': '$.tiers[].name', 'kind': 'STRING'}, {'path': '$.tiers[]', 'kind': 'BIGINT'}] ELSE [] END) END) AS x FROM e)
SELECT event_type, x.path AS path, x.kind AS kind, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL""",
    "variant_unknown_keys": "SELECT event_type, '$.' || k AS path, 'BIGINT' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL",
}
