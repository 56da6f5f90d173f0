"""Explicit schemas: nothing is inferred, and a field that a log lacks is null."""

from pyspark.sql import types as T

TOKENS = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cache_write_tokens", T.IntegerType()),
        T.StructField("cache_read_tokens", T.IntegerType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("source_file", T.StringType()),
    ]
)

#: Rows as the cache files them: with the number of the refresh that wrote them.
FILED = T.StructType([*TOKENS.fields, T.StructField("filed", T.LongType())])

#: Counts are read as text, so that a number in quotes counts as well.
CLAUDE = (
    "type string, cwd string, sessionId string, timestamp string, isSidechain boolean, message struct<model: string, "
    "usage: struct<input_tokens: string, output_tokens: string, cache_creation_input_tokens: string, cache_read_input_tokens: string>>"
)
CODEX = (
    "type string, timestamp string, payload struct<cwd: string, type: string, info: struct<total_token_usage: struct<total_tokens: string>, "
    "last_token_usage: struct<total_tokens: string, input_tokens: string, output_tokens: string, cached_input_tokens: string>>>"
)
GEMINI = "sessionId string, messages array<struct<timestamp: string, model: string, tokens: struct<input: string, output: string, cached: string, total: string>>>"
