"""The four reports: grand total, totals by tool, then details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.rollup import ALL, levels, summary


def _summaries_first(key: str) -> list[Column]:
    """Sorts on the written text, so a project that is named `*` stands with the summaries."""
    return [((F.col(key) == ALL) & (F.col("tool") == ALL)).desc(), (F.col(key) == ALL).desc()]


def _cut(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def by_project(tokens: DataFrame, limit: int | None = 50) -> DataFrame:
    rows = levels(tokens, ["project"]).select("project", "tool", *summary(), F.col("_first").alias("first_seen"), F.col("_last").alias("last_seen"), "_total")
    ordered = rows.orderBy(*_summaries_first("project"), F.col("_total").desc(), "project", "tool")
    return _cut(ordered, limit).drop("_total")


def by_date(tokens: DataFrame, limit: int | None = 50) -> DataFrame:
    rows = levels(tokens, ["date"], seen=False).select("date", "tool", *summary(), "_total")
    ordered = rows.orderBy(*_summaries_first("date"), F.col("date").desc(), F.col("_total").desc(), "tool")
    return _cut(ordered, limit).drop("_total")


def by_model(tokens: DataFrame, limit: int | None = None) -> DataFrame:
    """Details leave out rows without a model name; the totals do not. `limit` is accepted and not used."""
    # the condition reads a sum too, so it stays above the sums and all levels read one exchange
    named = F.when(F.col("_turns") > 0, F.col("model") != "")
    rows = levels(tokens, ["model"], seen=False).where((F.col("_level") > 0) | named).select("model", "tool", *summary(), "_total")
    return rows.orderBy(*_summaries_first("model"), F.col("_total").desc(), "model", "tool").drop("_total")


def by_session(tokens: DataFrame, limit: int | None = 50) -> DataFrame:
    rows = levels(tokens, ["project", "session"]).select("tool", "project", "session", *summary(), F.col("_first").alias("date"), "_total")
    ordered = rows.orderBy(*_summaries_first("project"), F.col("_total").desc(), "project", "session", "tool")
    return _cut(ordered, limit).drop("_total")


REPORTS = {"project": by_project, "date": by_date, "model": by_model, "session": by_session}
