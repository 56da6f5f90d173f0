"""Narrowing `tokens` by tool and by date."""

from __future__ import annotations

import math
import re
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = re.compile(r"(\d+)([hdw])")


def span_days(text: str | None) -> float | None:
    """Days of a span such as 24h, 7d or 2w; None for anything else."""
    found = SPAN.fullmatch(text or "")
    return int(found[1]) * {"h": 1 / 24, "d": 1, "w": 7}[found[2]] if found else None


def cutoff(since: str, today: date) -> str:
    """The first date kept: hours count back from midnight and round to whole days, other text stands for itself."""
    days = span_days(since)
    return since if days is None else (today - timedelta(days=math.ceil(round(days, 9)))).isoformat()


def since(tokens: DataFrame, text: str, today: date) -> DataFrame:
    """Rows from a date on. Dates compare as text; rows without a date stay."""
    return tokens.where(F.col("date").isNull() | (F.col("date") >= cutoff(text, today)))


def of_tool(tokens: DataFrame, tool: str) -> DataFrame:
    return tokens.where(F.col("tool") == tool)
