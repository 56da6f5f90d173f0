"""Sums of `tokens` at three levels from one scan: all, per tool, per tool and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.formatting import fmt, fmtcost, pattern
from tallymill.functions.pricing import cost_numerator

ALL = "*"
SUMS = {"_turns": F.count, "_total": F.sum, "_read": F.sum, "_output": F.sum, "_cost": F.sum}
SEEN = {"_first": F.min, "_last": F.max}


def _day(text: Column) -> Column:
    """A date as a day, so that sums with first and last days stay in hash aggregates; null for text that is no date."""
    return F.when(F.rlike(text, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), text.try_cast("date"))


def _measured(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns(
        {
            "_turns": F.lit(1),
            "_total": F.col("total_tokens"),
            "_read": F.col("cache_read_tokens"),
            "_output": F.col("output_tokens"),
            "_cost": cost_numerator(),
        }
    )


def _three(detail: DataFrame, columns: list[str], sums: dict) -> DataFrame:
    """Rows added up by tool and keys, by tool, and all: the two upper levels add up the lower one's sums, and read its exchange again."""
    again = [(F.sum if f is F.count else f)(name).alias(name) for name, f in sums.items()]
    tool = detail.groupBy("tool").agg(*again)
    whole = detail.agg(*again).withColumn("tool", F.lit(ALL))

    def named(rows: DataFrame, level: int) -> DataFrame:
        own = [F.lit(ALL).alias(c) if level else F.col(c) for c in columns[1:]]
        return rows.select("tool", *own, F.lit(level).alias("_level"), *sums)

    return named(detail, 0).unionByName(named(tool, 1)).unionByName(named(whole, 2))


def levels(tokens: DataFrame, keys: list[str], seen: bool = True) -> DataFrame:
    """Columns tool, the keys, `_level` (0 detail, 1 tool, 2 all) and the sums; with `seen` the first and last date, `_first` and `_last`,
    as text. Level 2 is one row even without input.

    The rows are scanned and added up once. Dates compare as text. Text that is a day is held as a day, and text that is
    none (an odd one) is a key of its own in that first sum, so everything is added up in hash aggregates; the few sums with
    odd dates are then rolled up by themselves and joined at the end.
    """
    columns = ["tool", *[k for k in keys if k != "tool"]]
    rows = _measured(tokens)
    if not seen:
        detail = rows.groupBy(*columns).agg(*[f(name).alias(name) for name, f in SUMS.items()])
        return _three(detail, columns, SUMS).withColumn("_turns", F.coalesce("_turns", F.lit(0)))
    rows = rows.withColumn("_day", _day(F.col("date"))).withColumns({"_odd": F.when(F.col("_day").isNull(), F.col("date")), "_first": F.col("_day"), "_last": F.col("_day")})
    both = SUMS | SEEN
    by_odd = rows.groupBy(*columns, "_odd").agg(*[f(name).alias(name) for name, f in both.items()])
    again = [(F.sum if f is F.count else f)(name).alias(name) for name, f in both.items()]
    days = _three(by_odd.groupBy(*columns).agg(*again), columns, both).withColumn("_turns", F.coalesce("_turns", F.lit(0)))
    # the condition reads a sum too, so it stays above the sums and both branches read one exchange
    odd = by_odd.where("_turns > 0 and _odd is not null").withColumns({"_first": F.col("_odd"), "_last": F.col("_odd")})
    odd = _three(odd.groupBy(*columns).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")), columns, SEEN)
    odd = odd.where("_first is not null").toDF(*[f"_o{c}" for c in odd.columns])
    same = F.col("_level") == F.col("_o_level")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_o{c}"))
    joined = days.join(odd, same, "left")
    text = {"_first": F.least(F.col("_first").cast("string"), F.col("_o_first")), "_last": F.greatest(F.col("_last").cast("string"), F.col("_o_last"))}
    return joined.withColumns(text).select("tool", *columns[1:], "_level", *both)


def summary() -> list[Column]:
    """The formatted columns of the reports, from the sums."""
    billable = F.col("_total") - F.col("_read") * F.lit("0.9").cast("decimal(2,1)")
    rate = F.lit(100.0) * F.col("_read") / F.greatest(F.col("_total") - F.col("_output"), F.lit(1))
    return [
        F.col("_turns").cast("int").alias("turns"),
        fmt(F.col("_total")).alias("total"),
        fmt(billable).alias("billable"),
        fmt(F.col("_output")).alias("output"),
        F.lpad(F.concat(pattern(rate, "0"), F.lit("%")), 4, " ").alias("cache"),
        fmtcost(F.col("_cost").cast("double") / 1e6).alias("api_cost"),
    ]
