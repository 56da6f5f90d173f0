"""Readers that turn the session logs of three coding assistants into `tokens` rows.

Each takes a list of files and returns a lazily composed frame with the columns of schemas.TOKENS. Malformed lines become
all-null rows, which the predicates drop; lines of over `LONGEST` bytes are passed over. A `Tally` counts both, and what is read and
kept, in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.sources import schemas
from tallymill.sources.storage import plain_path


#: Bytes of the longest line, or document, that is read.
LONGEST = 64 << 20
#: Where the parser puts what it could not read.
BAD = "_bad string"


class Tally:
    """Counts of a read, by tool: records `read`, `malformed` (no JSON, or a field of another kind), `too_long`, and rows `kept`.

    They are gathered while the rows are written or collected, so `counts` waits for the first such action. This should stand in
    `gathering`: otherwise a plan that turns out to give no rows is cut short at run time, and its counts are lost.
    """

    def __init__(self):
        self._watched: list[tuple[str, Observation, list[str]]] = []

    def watch(self, tool: str, rows: DataFrame, **counts: Column) -> DataFrame:
        seen = Observation(f"{tool} {len(self._watched)}")
        self._watched.append((tool, seen, list(counts)))
        return rows.observe(seen, *[c.alias(name) for name, c in counts.items()])

    @staticmethod
    @contextmanager
    def gathering(spark: SparkSession) -> Iterator[None]:
        """Keeps observations of empty parts of a plan: leaves out the rule that cuts such parts off."""
        name, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
        before = spark.conf.get(name, None)
        spark.conf.set(name, f"{before},{rule}" if before else rule)
        try:
            yield
        finally:
            spark.conf.set(name, before) if before else spark.conf.unset(name)

    def counts(self) -> dict[str, dict[str, int]]:
        found: dict[str, dict[str, int]] = {}
        for tool, seen, names in self._watched:
            try:
                counts = seen.get
            except Py4JJavaError:  # no row came there, and the plan was cut short at run time
                counts = dict.fromkeys(names, 0)
            found.setdefault(tool, {}).update(counts)
        return found


def _watched(tally: Tally | None, tool: str, records: DataFrame) -> DataFrame:
    """Counts records with the columns `fits` (short enough) and `bad` (what the parser could not read)."""
    if tally is None:
        return records
    return tally.watch(tool, records, read=F.count(F.lit(1)), malformed=F.count_if(F.col("bad").isNotNull()), too_long=F.count_if(~F.col("fits")))


def _kept(tally: Tally | None, tool: str, rows: DataFrame) -> DataFrame:
    return rows if tally is None else tally.watch(tool, rows, kept=F.count(F.lit(1)))


def _lines(texts: DataFrame, schema: str, tool: str, tally: Tally | None, longest: int) -> DataFrame:
    """JSON lines, read as text, with the fields of a schema, and `source_file`. Blank lines are no records."""
    lines = texts.select(_path().alias("source_file"), "value").where(F.rlike("value", F.lit(r"\S")))
    fits = F.octet_length("value") <= longest
    parsed = F.from_json(F.when(F.col("fits"), F.col("value")), f"{schema}, {BAD}", {"columnNameOfCorruptRecord": BAD.split()[0]})
    records = lines.withColumn("fits", fits).select("source_file", "fits", parsed.alias("_of")).withColumn("bad", F.col("_of._bad"))
    return _watched(tally, tool, records).select("source_file", "_of.*")


def _path() -> Column:
    """The file's path as the manifest has it."""
    return plain_path("_metadata.file_path")


def _last_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def _whole(field: str, kind: str = "int") -> Column:
    """A whole number that a log may give as a number or as text; other values are null."""
    return F.col(field).try_cast("decimal(20,0)").try_cast(kind)


def _count(field: str) -> Column:
    return F.coalesce(_whole(field), F.lit(0))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.TOKENS)


def project_of(folder: Column, otherwise: Column) -> Column:
    """The last part of a working folder of either kind of path, in lower case; another name where that is empty."""
    return F.lower(F.coalesce(F.nullif(_last_segment(F.replace(folder, F.lit("\\"), F.lit("/"))), F.lit("")), otherwise))


def hashed_project(folder: Column) -> Column:
    """A folder named by a hash is shortened to eight digits; others are in lower case."""
    return F.when(F.rlike(folder, F.lit("^[0-9a-f]{64}$")), F.substring(folder, 1, 8)).otherwise(F.lower(folder))


def named_model(model: Column) -> Column:
    """Whether a turn came from a model: not from a synthetic one, and not from one unknown."""
    return model != "<synthetic>"


def with_headers(steps: DataFrame, headers: DataFrame) -> DataFrame:
    """Steps of a file once for each of its headers; a file without one stays."""
    return steps.join(headers, "source_file", "left")


def read_claude(spark: SparkSession, files: Sequence[str], tally: Tally | None = None, longest: int = LONGEST) -> DataFrame:
    """One row per assistant turn with usage, outside side chains and synthetic models; unknown models do not count."""
    wanted = [f for f in files if "/subagents/" not in f.replace("\\", "/")]
    if not wanted:
        return _empty(spark)
    log = _lines(spark.read.text(wanted), schemas.CLAUDE, "Claude Code", tally, longest)
    folder = F.regexp_extract("source_file", "projects/([^/]+)/", 1)
    kept = log.where(
        (F.col("type") == "assistant")
        & (F.col("isSidechain").isNull() | ~F.col("isSidechain"))
        & named_model(F.col("message.model"))
        & F.col("message.usage").isNotNull()
        & F.col("timestamp").isNotNull()
    )
    usage = "message.usage."
    rows = kept.select(
        F.lit("Claude Code").alias("tool"),
        project_of(F.col("cwd"), folder).alias("project"),
        F.col("sessionId").alias("session"),
        F.substring("timestamp", 1, 10).alias("date"),
        F.col("message.model").alias("model"),
        _count(f"{usage}input_tokens").alias("input_tokens"),
        _count(f"{usage}output_tokens").alias("output_tokens"),
        _count(f"{usage}cache_creation_input_tokens").alias("cache_write_tokens"),
        _count(f"{usage}cache_read_input_tokens").alias("cache_read_tokens"),
        "source_file",
    )
    parts = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
    total = sum((F.col(c).cast("long") for c in parts), F.lit(0).cast("long"))
    return _kept(tally, "Claude Code", rows.withColumn("total_tokens", total).select(schemas.TOKENS.fieldNames()))


def counter_deltas(entries: DataFrame, key: str, order: Sequence[str], cumulative: str, last: str) -> DataFrame:
    """Turns a running counter with optional last-step values into steps: column `delta`, rows that repeat the counter left out.

    A row's predecessor is the row before it, kept or not; a row without a counter breaks the chain.
    """
    before = F.lag(cumulative).over(Window.partitionBy(key).orderBy(*order))
    stepped = entries.withColumn("_before", before).withColumn(
        "delta",
        F.when(F.col(last) > 0, F.col(last))
        .when(F.col(cumulative).isNotNull() & F.col("_before").isNotNull(), F.col(cumulative) - F.col("_before"))
        .otherwise(F.lit(0).cast("long")),
    )
    fresh = F.col(cumulative).isNull() | (F.col(cumulative) != F.coalesce("_before", F.lit(-1)))
    return stepped.where(fresh & (F.col("delta") > 0)).drop("_before")


def read_codex(
    spark: SparkSession, files: Sequence[str], tally: Tally | None = None, longest: int = LONGEST, dedupe_session_meta: bool = False
) -> DataFrame:
    """One row per step of a session's token counter. A file with several session headers yields its steps once for each,
    unless `dedupe_session_meta`."""
    if not files:
        return _empty(spark)
    texts = spark.read.text(list(files))  # listed once
    lines = lambda counted: (
        _lines(texts, schemas.CODEX, "Codex", counted, longest)
        .select("type", "timestamp", "payload", "source_file", F.monotonically_increasing_id().alias("_line"))
        .where(F.col("type").isin("session_meta", "event_msg"))
    )
    # headers and steps are read by a scan each; one of them counts
    log, headers = lines(tally), lines(None)
    headers = headers.where(F.col("type") == "session_meta").select("source_file", _last_segment(F.col("payload.cwd")).alias("_project"))
    if dedupe_session_meta:
        headers = headers.groupBy("source_file").agg(F.min("_project").alias("_project"))
    info = F.col("payload.info")
    entries = log.where(
        (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & info.isNotNull() & F.col("timestamp").isNotNull()
    ).select(
        "source_file",
        "timestamp",
        "_line",
        _whole("payload.info.total_token_usage.total_tokens", "long").alias("_running"),
        _whole("payload.info.last_token_usage.total_tokens", "long").alias("_last"),
        _count("payload.info.last_token_usage.input_tokens").alias("input_tokens"),
        _count("payload.info.last_token_usage.output_tokens").alias("output_tokens"),
        _count("payload.info.last_token_usage.cached_input_tokens").alias("cache_read_tokens"),
    )
    steps = counter_deltas(entries, "source_file", ("timestamp", "_line"), "_running", "_last")
    stem = F.regexp_extract("source_file", r"([^/]+)[.]jsonl", 1)
    rows = with_headers(steps, headers).select(
        F.lit("Codex").alias("tool"),
        F.lower(F.coalesce("_project", stem)).alias("project"),
        stem.alias("session"),
        F.substring("timestamp", 1, 10).alias("date"),
        F.lit("").alias("model"),
        "input_tokens",
        "output_tokens",
        F.lit(0).alias("cache_write_tokens"),
        "cache_read_tokens",
        F.col("delta").alias("total_tokens"),
        "source_file",
    )
    return _kept(tally, "Codex", rows)


def read_gemini(spark: SparkSession, files: Sequence[str], tally: Tally | None = None, longest: int = LONGEST) -> DataFrame:
    """One row per message with tokens; each file is one JSON document, a chat or an array of chats. Hashed project folders are shortened to
    eight digits.

    Documents are read as text: the reader of JSON files opens the file anew for every number that is taken as text.
    """
    if not files:
        return _empty(spark)
    texts = spark.read.text(list(files), wholetext=True).select(
        _path().alias("source_file"), (F.col("_metadata.file_size") <= longest).alias("fits"), F.regexp_replace("value", "^\ufeff", "").alias("value")
    )
    array = F.when(F.col("fits") & F.rlike("value", F.lit(r"^\s*\[")), F.from_json("value", "array<string>"))
    parsed = F.from_json(F.when(F.col("fits"), F.col("value")), f"{schemas.GEMINI}, {BAD}", {"columnNameOfCorruptRecord": BAD.split()[0]})
    chats = texts.where(F.rlike("value", F.lit(r"\S"))).select("source_file", "fits", F.explode(F.coalesce(array, F.array("value"))).alias("value"))
    chats = chats.select("source_file", "fits", parsed.alias("_of")).select("_of.sessionId", "_of.messages", F.col("_of._bad").alias("bad"), "fits", "source_file")
    chats = _watched(tally, "Gemini", chats).where("fits")
    said = chats.select("sessionId", "source_file", F.explode("messages").alias("m")).where(
        F.col("m.tokens").isNotNull() & (_whole("m.tokens.total") > 0)
    )
    own = F.nullif(F.regexp_extract("source_file", r"\.gemini/tmp/([^/]+)/", 1), F.lit(""))  # before any other folder of that name
    folder = F.coalesce(own, F.regexp_extract("source_file", "tmp/([^/]+)/", 1))
    rows = said.select(
        F.lit("Gemini").alias("tool"),
        hashed_project(folder).alias("project"),
        F.col("sessionId").alias("session"),
        F.substring("m.timestamp", 1, 10).alias("date"),
        F.col("m.model").alias("model"),
        _count("m.tokens.input").alias("input_tokens"),
        _count("m.tokens.output").alias("output_tokens"),
        F.lit(0).alias("cache_write_tokens"),
        _count("m.tokens.cached").alias("cache_read_tokens"),
        _whole("m.tokens.total", "long").alias("total_tokens"),
        "source_file",
    )
    return _kept(tally, "Gemini", rows)


#: Key on the command line: tool name, reader.
SOURCES = {"claude": ("Claude Code", read_claude), "codex": ("Codex", read_codex), "gemini": ("Gemini", read_gemini)}


def read_all(spark: SparkSession, by_tool: dict[str, Sequence[str]], tally: Tally | None = None) -> DataFrame:
    """Rows of all files, given by tool name; `tally` counts what is read."""
    out = _empty(spark)
    for tool, reader in SOURCES.values():
        if files := sorted(by_tool.get(tool, ())):
            out = out.unionByName(reader(spark, files, tally))
    return out
