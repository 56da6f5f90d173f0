"""Prices, in USD per million tokens, as columns.

`cost_numerator` is exact: decimals, divided by a million only after adding up, so a total does not depend on how rows are
dealt to tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tool, LIKE pattern of the model (None: any), prices of input, cache write, cache read and output tokens.
#: Read from top to bottom; the first line that fits counts. A tool of None is any tool not named above.
RATES = [
    ("Codex", None, "1.25", "1.25", "0.125", "10.0"),
    ("Gemini", "%flash%", "0.15", "0", "0.0375", "0.60"),
    ("Gemini", "%2.5%pro%", "1.25", "0", "0.125", "10.0"),
    ("Gemini", None, "2.0", "0", "0.50", "12.0"),
    (None, "%opus%", "5.0", "6.25", "0.50", "25.0"),
    (None, "%haiku%", "1.0", "1.25", "0.10", "5.0"),
    (None, None, "3.0", "3.75", "0.30", "15.0"),
]
PARTS = ("input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens")


def cost_numerator() -> Column:
    """Cost of a row in millionths of a USD, decimal(24,4)."""
    expr = None
    for tool, model, *prices in RATES:
        terms = [F.col(c) * F.lit(Decimal(p)).cast("decimal(8,4)") for c, p in zip(PARTS, prices, strict=True) if Decimal(p)]
        value = sum(terms[1:], terms[0]).cast("decimal(24,4)")
        fits = F.lit(True) if tool is None else F.col("tool") == tool
        if model is not None:
            fits = fits & F.col("model").like(model)
        expr = F.when(fits, value) if expr is None else expr.when(fits, value)
    return expr


def total_cost() -> Column:
    """Aggregate: cost in USD; null without rows."""
    return F.sum(cost_numerator()).cast("double") / 1e6
