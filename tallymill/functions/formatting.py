"""Number formats of the reports, as columns, as SQL functions and as plain Python."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STEPS = ((1e9, "B"), (1e6, "M"), (1e3, "k"))


def pattern(x: Column, shape: str) -> Column:
    """A number written by a decimal pattern; rounds halves to even on the exact binary value, as C's printf does."""
    return F.call_function("format_number", x, F.lit(shape))


def fmt(n: Column) -> Column:
    """A count in seven characters: 9700 as `   9.7k`; below a thousand as the number's own text."""
    x, out = n.cast("double"), None
    for size, letter in STEPS:
        text = F.concat(pattern(x / size, "0.0"), F.lit(letter))
        out = F.when(x >= size, text) if out is None else out.when(x >= size, text)
    return F.lpad(out.otherwise(n.cast("string")), 7, " ")


def fmtcost(n: Column) -> Column:
    """A cost in USD: two decimals below 10, one below 100, none above."""
    x = n.cast("double")
    return F.concat(
        F.lit("$"), F.when(x < 10, pattern(x, "0.00")).when(x < 100, pattern(x, "0.0")).otherwise(pattern(x, "0"))
    )


def register(spark: SparkSession) -> None:
    """Makes fmt and fmtcost available to SQL text. Both have SQL bodies."""
    steps = " ".join(f"WHEN double(n) >= {s:.0f}D THEN concat(format_number(double(n) / {s:.0f}D, '0.0'), '{x}')" for s, x in STEPS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fmt(n STRING) RETURNS STRING RETURN lpad(CASE {steps} ELSE n END, 7, ' ')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fmtcost(n DOUBLE) RETURNS STRING RETURN concat('$', CASE WHEN n < 10 THEN format_number(n, '0.00') "
        "WHEN n < 100 THEN format_number(n, '0.0') ELSE format_number(n, '0') END)"
    )


def short_count(n: float) -> str:
    """Like fmt, unpadded."""
    for size, letter in STEPS:
        if n >= size:
            return f"{n / size:.1f}{letter}"
    return str(n)


def card_count(n: int) -> str:
    """Whole thousands, millions and billions go without a decimal."""
    for size, letter in STEPS:
        if n >= size:
            return f"{n / size:.{0 if n % size == 0 else 1}f}{letter}"
    return str(n)


def card_cost(n: float) -> str:
    if n >= 1000:
        return f"${n:,.0f}"
    return f"${n:.{0 if n >= 100 else 1 if n >= 10 else 2}f}"


def stamp(seconds: float) -> str:
    """Local time of a file stamp; n/a where there is none."""
    return datetime.fromtimestamp(seconds).isoformat(sep=" ", timespec="seconds") if seconds > 0 else "n/a"


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def short_date(date: str) -> str:
    _, month, day = date.split("-")
    return f"{MONTHS[int(month) - 1]} {int(day)}"
