"""Datasets behind the usage chart, and the texts around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.formatting import card_cost
from tallymill.functions.pricing import cost_numerator, total_cost
from tallymill.operators.filters import span_days


def totals(tokens: DataFrame) -> DataFrame:
    billable = F.sum("total_tokens") - F.sum("cache_read_tokens") * F.lit("0.9").cast("decimal(2,1)")
    return tokens.agg(
        F.sum("total_tokens").alias("total"),
        F.round(billable).cast("long").alias("billable"),
        F.countDistinct("tool").cast("int").alias("n_tools"),
        F.countDistinct("project").cast("int").alias("n_projects"),
        total_cost().alias("cost"),
    )


def tool_costs(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tool").agg(total_cost().alias("cost")).orderBy(F.col("cost").desc(), "tool")


def date_count(tokens: DataFrame) -> DataFrame:
    """How many dates there are: up to three are drawn as bars, more as an area."""
    return tokens.agg(F.countDistinct("date").cast("int").alias("n"))


def chart_kind(dates: int) -> str:
    return "bars" if dates <= 3 else "area"


def top_projects(tokens: DataFrame, top: int = 10) -> DataFrame:
    """Cost by tool of the projects that cost most. The list of projects has `top` rows, so it is sent to every task."""
    leading = tokens.groupBy("project").agg(total_cost().alias("_c")).orderBy(F.col("_c").desc(), "project").limit(top).select("project")
    costs = tokens.join(F.broadcast(leading), "project").groupBy("project", "tool").agg(total_cost().alias("cost"))
    return costs.orderBy(F.col("cost").desc(), "project", "tool")


def daily_costs(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("date", "tool").agg(total_cost().alias("cost")).orderBy(F.col("date").asc_nulls_last(), "tool")


def moving_costs(tokens: DataFrame, days: int = 7) -> DataFrame:
    """Daily cost by tool, and that of the `days` days up to it. The frame goes by days, so a day without rows counts as nothing; rows
    whose date is no day are left out. Rows are added up by day first, so the window sees one row a tool and day."""
    day = F.when(F.rlike("date", F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.col("date").try_cast("date"))
    daily = tokens.groupBy("tool", day.alias("day")).agg(F.sum(cost_numerator()).alias("c")).where("day is not null")
    moving = daily.withColumn("m", F.expr(f"sum(c) over (partition by tool order by day range between interval {days - 1} days preceding and current row)"))
    cost = lambda c: F.col(c).cast("double") / 1e6
    return moving.select("tool", F.col("day").cast("string").alias("date"), cost("c").alias("cost"), cost("m").alias(f"cost_{days}d"))


def daily_costs_wide(tokens: DataFrame, tools: list[str]) -> DataFrame:
    """One column a tool; dates without a tool cost 0 there."""
    return tokens.groupBy("date").pivot("tool", tools).agg(total_cost()).na.fill(0.0, tools).orderBy(F.col("date").asc_nulls_last())


#: Fixed values per million billable tokens: kilowatt hours, litres of water, kilograms of CO2.
FOOTPRINT = {"kwh": 0.6, "liters": 1.0, "co2_kg": 0.09}


def footprint(tokens: DataFrame) -> DataFrame:
    return totals(tokens).select("billable", *[(F.col("billable") * x / 1e6).alias(name) for name, x in FOOTPRINT.items()])


def footprint_labels(billable: int) -> list[str]:
    kwh, liters, kg = (billable * x / 1e6 for x in FOOTPRINT.values())
    labels = []
    if kwh >= 0.01:
        labels.append(f"{kwh:,.0f}kWh" if kwh >= 1 else f"{kwh:.1f}kWh")
    if liters >= 1:
        labels.append(f"{liters / 1000:,.1f}m³" if liters >= 1000 else f"{liters:,.0f}L")
    if kg >= 0.01:
        labels.append(f"{kg:,.0f}kg" if kg >= 1 else f"{kg:.1f}kg")
    return labels


def period(since: str | None) -> str:
    return {"24h": "today", "1d": "today", "7d": "this week", "1w": "this week"}.get(since or "", "")


def subscription_label(cost: float, monthly: float, since: str | None, mode: str = "auto") -> str:
    """What the use is set against: a month's price while it costs less than that, else the price of the period."""
    if not monthly:
        return ""
    if mode == "monthly" or (mode == "auto" and cost < monthly):
        return f" for ${monthly}/mo"
    days = span_days(since)
    return f" for {card_cost(monthly * (30 if days is None else days) / 30)}"


def multiple(cost: float, monthly: float, since: str | None) -> str:
    days = span_days(since)
    share = monthly * (30 if days is None else days) / 30
    return f" ({cost / share:.0f}x)" if monthly and cost >= monthly and share and cost / share >= 2 else ""


def headline(cost: float, monthly: float, since: str | None, mode: str = "auto") -> str:
    when = period(since)
    return f"{card_cost(cost)} of AI compute{f' {when}' if when else ''}{subscription_label(cost, monthly, since, mode)}{multiple(cost, monthly, since)}"


def share_text(cost: float, monthly: float, since: str | None) -> str:
    """The text to share; it compares as `auto` does, whatever the mode of the chart."""
    return f"{card_cost(cost)} of AI compute {period(since)}{subscription_label(cost, monthly, since)}"
