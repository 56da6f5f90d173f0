from datetime import date
from xml.etree import ElementTree

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallymill.functions import formatting, subscriptions
from tallymill.functions.pricing import cost_numerator, total_cost
from tallymill.operators import filters
from tallymill.plans import charts, drawing, reports
from tallymill.sources import schemas

#: tool, project, session, date, model, input, output, cache write, cache read, total; then the prices of the last four kinds in USD a million.
ROWS = [
    (("Claude Code", "atlas", "a1", "2026-02-03", "claude-sonnet-4-5", 1200, 340, 700, 9100, 11340, "f1"), (3, 15, 3.75, 0.3)),
    (("Claude Code", "atlas", "a2", "2026-02-05", "claude-opus-4-1", 4100, 820, 0, 51000, 55920, "f2"), (5, 25, 6.25, 0.5)),
    (("Claude Code", "delta", "d1", "2026-02-05", "claude-haiku-3-5", 90, 15, 33, 610, 748, "f3"), (1, 5, 1.25, 0.1)),
    (("Codex", "borealis", "b1", "2026-02-04", "", 2300, 410, 0, 7700, 10410, "f4"), (1.25, 10, 1.25, 0.125)),
    (("Codex", "atlas", "b2", "2026-02-03", "", 5, 1, 0, 0, 6, "f5"), (1.25, 10, 1.25, 0.125)),
    (("Gemini", "cirrus", "c1", "2026-02-04", "gemini-2.5-pro", 640, 70, 0, 310, 1020, "f6"), (1.25, 10, 0, 0.125)),
    (("Gemini", "cirrus", "c2", "2026-02-06", "gemini-2.5-flash", 8800, 900, 0, 1200, 10900, "f7"), (0.15, 0.6, 0, 0.0375)),
    (("Gemini", "cirrus", "c3", None, "gemini-3-pro", 77, 8, 0, 0, 85, "f8"), (2, 12, 0, 0.5)),
]
PLAIN = [r for r, _ in ROWS]


def price(row, prices):
    return sum(n * p for n, p in zip((row[5], row[6], row[7], row[8]), prices, strict=True)) / 1e6


COST = {r[10]: price(r, p) for r, p in ROWS}


@pytest.fixture
def tokens(spark):
    return spark.createDataFrame(PLAIN, schemas.TOKENS)


def summed(rows):
    """The columns of a report from its rows, by plain arithmetic."""
    total, read, output = (sum(r[k] for r in rows) for k in (9, 8, 6))
    cost = sum(COST[r[10]] for r in rows)
    billable = total - 0.9 * read
    days = [r[3] for r in rows if r[3]]
    return (
        len(rows),
        formatting.short_count(total).rjust(7),
        (formatting.short_count(billable) if billable >= 1000 else f"{billable:.1f}").rjust(7),
        formatting.short_count(output).rjust(7),
        f"{100 * read / max(total - output, 1):.0f}%".rjust(4),
        f"${cost:.{2 if cost < 10 else 1 if cost < 100 else 0}f}",
        min(days, default=None),
        max(days, default=None),
    )


def expected(column):
    """Grand total, tools, then details, each from the most tokens down."""
    size = lambda rows: -sum(r[9] for r in rows)
    tools = {t: [r for r in PLAIN if r[0] == t] for t in sorted({r[0] for r in PLAIN})}
    details = {(r[column], r[0]): [x for x in PLAIN if (x[column], x[0]) == (r[column], r[0])] for r in PLAIN}
    return [
        ("*", "*", *summed(PLAIN)),
        *sorted((("*", t, *summed(rows)) for t, rows in tools.items()), key=lambda r: size(tools[r[1]])),
        *sorted(((*k, *summed(rows)) for k, rows in details.items()), key=lambda r: (size(details[r[:2]]), r[:2])),
    ]


def test_by_project(tokens):
    assert [tuple(r) for r in reports.by_project(tokens).collect()] == expected(1)


def test_by_date_and_model(tokens):
    by_day = {r[:2]: r[:8] for r in expected(3)}
    dated = [tuple(r) for r in reports.by_date(tokens).collect()]
    assert {r[:2]: r for r in dated} == by_day
    days = [r[0] for r in dated[4:]]
    assert days == ["2026-02-06", "2026-02-05", "2026-02-04", "2026-02-04", "2026-02-03", "2026-02-03", None]
    models = [tuple(r) for r in reports.by_model(tokens, 1).collect()]
    assert models == [r[:8] for r in expected(4) if r[0] != ""]


def test_by_session_and_limit(tokens):
    rows = reports.by_session(tokens).collect()
    assert [(r.project, r.session, r.date) for r in rows[4:6]] == [("atlas", "a2", "2026-02-05"), ("atlas", "a1", "2026-02-03")]
    assert reports.by_session(tokens, 3).count() == 3 and len(rows) == 4 + len(PLAIN)


def test_empty_report(tokens):
    (row,) = reports.by_project(tokens.where("false")).collect()
    assert (row.project, row.tool, row.turns, row.total, row.api_cost, row.first_seen) == ("*", "*", 0, None, None, None)


@pytest.mark.parametrize("name", list(reports.REPORTS))
def test_reports_scan_once(spark, tmp_path, name):
    """One scan; all levels read the exchange of the first sums, and without odd dates there are hash aggregates and no join."""
    spark.createDataFrame(PLAIN, schemas.TOKENS).write.parquet(str(tmp_path / "tokens"))
    report = reports.REPORTS[name](spark.read.parquet(str(tmp_path / "tokens")))
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 2 and "Expand" not in plan
    assert "SortAggregate" not in plan and "Join" not in plan


ODD = [("x", "2026/03/01"), ("x", None), ("x", "2026-01-05"), ("y", "soon"), ("y", "soon"), ("y", "2026-02-31"), (None, "2026-02-01"), (None, ""), ("z", None)]


def test_odd_dates(spark):
    """First and last dates compare as text, whatever the text is."""
    rows = spark.createDataFrame([("Codex", p, f"s-{p}", d, "", 1, 1, 0, 0, 2, "f") for p, d in ODD], schemas.TOKENS)
    days = lambda p: sorted(d for q, d in ODD if (p == "*" or q == p) and d is not None) or [None]
    for r in reports.by_project(rows).collect():
        assert (r.first_seen, r.last_seen) == (days(r.project)[0], days(r.project)[-1])
    assert {r.project: r.date for r in reports.by_session(rows).collect()} == {p: days(p)[0] for p in ("*", "x", "y", None, "z")}


@pytest.mark.parametrize(("row", "prices"), ROWS)
def test_cost(spark, row, prices):
    assert spark.createDataFrame([row], schemas.TOKENS).agg(total_cost()).first()[0] == pytest.approx(price(row, prices), abs=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 7))
def test_cost_does_not_depend_on_partitions(tokens, n):
    assert tokens.repartition(n).agg(total_cost()).first()[0] == round(sum(COST.values()), 9)


def test_cost_is_exact(tokens):
    assert str(tokens.select(cost_numerator().alias("c")).schema["c"].dataType) == "DecimalType(24,4)"


def test_charts(tokens):
    of = lambda *tools: pytest.approx(sum(COST[r[10]] for r in PLAIN if r[0] in tools), abs=1e-9)
    whole = charts.totals(tokens).first()
    assert (whole[0], whole[2], whole[3]) == (sum(r[9] for r in PLAIN), 3, 4) and whole[4] == of("Claude Code", "Codex", "Gemini")
    assert whole[1] == round(sum(r[9] - 0.9 * r[8] for r in PLAIN))
    assert [tuple(r) for r in charts.tool_costs(tokens).collect()] == [(t, of(t)) for t in ("Claude Code", "Codex", "Gemini")]
    assert charts.top_projects(tokens, 1).collect()[0][0] == "atlas"
    wide = charts.daily_costs_wide(tokens, ["Claude Code", "Codex"]).collect()
    assert [(r["date"], r["Codex"]) for r in wide if r["date"]] == [("2026-02-03", COST["f5"]), ("2026-02-04", COST["f4"]), ("2026-02-05", 0.0), ("2026-02-06", 0.0)]
    assert charts.totals(tokens.where("false")).first()["total"] is None


@pytest.mark.parametrize(("n", "text"), [(1_500_000_000, "1.5B"), (2_000_000_000, "2B"), (465_600_000, "465.6M"), (3_000_000, "3M"), (12_500, "12.5k"), (5000, "5k"), (42, "42"), (0, "0")])
def test_card_count(n, text):
    assert formatting.card_count(n) == text


@pytest.mark.parametrize(("n", "text"), [(3841.5, "$3,842"), (91.15, "$91.2"), (8.6, "$8.60"), (0.49, "$0.49"), (0, "$0.00"), (1000, "$1,000"), (100, "$100"), (10, "$10.0")])
def test_card_cost(n, text):
    assert formatting.card_cost(n) == text


def test_short_forms():
    assert [formatting.short_count(x) for x in (883_400_000, 24_100, 42, 10**9, 1000)] == ["883.4M", "24.1k", "42", "1.0B", "1.0k"]
    assert formatting.stamp(0) == "n/a" and formatting.stamp(1e9).startswith("2001-09-0")
    assert [charts.chart_kind(n) for n in (1, 3, 4)] == ["bars", "bars", "area"]
    assert [formatting.short_date(x) for x in ("2026-03-15", "2026-01-01", "2026-12-31")] == ["Mar 15", "Jan 1", "Dec 31"]


def test_sql_functions(spark):
    formatting.register(spark)
    row = spark.sql("SELECT fmt(9700), fmt(42), fmt(570.0BD), fmt(-5), fmt(999950), fmt(10000000000000), fmt(NULL), fmtcost(8.5D), fmtcost(9.996D), fmtcost(3841.0D), fmtcost(NULL)").first()
    assert tuple(row) == ("   9.7k", "     42", "  570.0", "     -5", "1000.0k", "10000.0", None, "$8.50", "$10.00", "$3841", None)


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(1000, 10**12), min_size=200, max_size=200))
def test_fmt_rounds_as_printf(spark, values):
    got = [r[0].strip() for r in spark.createDataFrame([(v,) for v in values], "n long").coalesce(1).select(formatting.fmt(__import__("pyspark").sql.functions.col("n"))).collect()]
    assert got == [formatting.short_count(v) for v in values]


@pytest.mark.parametrize(("text", "day"), [("1h", "2026-03-15"), ("24h", "2026-03-15"), ("36h", "2026-03-14"), ("2w", "2026-03-02"), ("7d", "2026-03-09"), ("2026-01-01", "2026-01-01")])
def test_cutoff(text, day):
    assert filters.cutoff(text, date(2026, 3, 16)) == day


def test_since_keeps_undated(spark):
    rows = spark.createDataFrame(PLAIN, schemas.TOKENS)
    assert sorted(r.session for r in filters.since(rows, "1d", date(2026, 2, 6)).collect()) == ["a2", "c2", "c3", "d1"]
    assert filters.of_tool(rows, "Gemini").count() == 3


def test_texts():
    assert charts.footprint_labels(9720) == [] and charts.footprint_labels(2_000_000_000) == ["1,200kWh", "2.0m³", "180kg"]
    assert charts.headline(100.0, 200, "7d") == "$100 of AI compute this week for $200/mo"
    assert charts.headline(1000.0, 200, "7d") == "$1,000 of AI compute this week for $46.7 (21x)"
    assert charts.headline(100.0, 200, "24h", "prorated") == "$100 of AI compute today for $6.67"
    assert charts.share_text(5.0, 0, None) == "$5.00 of AI compute "


@pytest.mark.parametrize(
    ("tool", "report", "plan"),
    [
        ("Claude Code", '{"plan":"max_20x"}', ("max_20x", 200)),
        ("Claude Code", '{"plan":"default_claude_max_5x"}', ("max_5x", 100)),
        ("Codex", '{"plan":"pro"}', ("pro", 200)),
        ("Codex", '{"plan":"plus"}', ("plus", 20)),
        ("Gemini", '{"account_quota":{"user_tier":"g1-pro-tier"}}', ("pro", 20)),
        ("Gemini", '{"account_quota":{"user_tier":"g1-ultra-tier"}}', ("ultra", 250)),
        ("Gemini", "not json", None),
        ("Gemini", "[1]", None),
        ("Gemini", '{"plan": 3}', None),
        ("Gemini", '{"account_quota": []}', None),
        ("Gemini", '{"account_quota": null}', ("unknown", 0)),
        ("Codex", '{"plan": "", "account_quota": {"user_tier": "default_claude_pro"}}', ("pro", 200)),
        ("Claude Code", '{"plan": "team"}', ("team", 0)),
    ],
)
def test_plans(tool, report, plan):
    assert subscriptions.plan_of(tool, report) == plan
    assert subscriptions.detect(subscriptions.reports({tool: "asked", "Other": "not"}, lambda command: report if command == "asked" else None)) == ({tool: plan} if plan else {})
    assert subscriptions.printed("no-such-command-here json") is None and subscriptions.reports({}) == {}
    assert subscriptions.detect({tool: report, "other": None}) == ({tool: plan} if plan else {})


def test_moving_costs_over_missing_days(spark):
    """The frame goes by days: a gap of days is not bridged, and rows whose date is no day are left out."""
    days = ["2026-03-01", "2026-03-02", "2026-03-07", "2026-03-08", "2026-03-09", "2026-03-31", "2026-03-31", "soon", None]
    rows = spark.createDataFrame([("Codex", "p", "s", d, "", 0, 10 ** (i % 7), 0, 0, 1, "f") for i, d in enumerate(days)], schemas.TOKENS)
    cost = {}
    for i, d in enumerate(days):
        if d and d != "soon":
            cost[date.fromisoformat(d)] = cost.get(date.fromisoformat(d), 0) + 10 ** (i % 7) * 10 / 1e6
    got = {r.date: (r.cost, r.cost_7d) for r in charts.moving_costs(rows).collect()}
    assert set(got) == {d.isoformat() for d in cost}
    for d in cost:
        moving = sum(c for other, c in cost.items() if 0 <= (d - other).days <= 6)
        assert got[d.isoformat()] == pytest.approx((cost[d], moving))


@pytest.mark.parametrize("days", [2, 5, 40])
def test_drawing(days):
    """Columns by project for few dates, areas by day for many; the stacks reach as high as the costs."""
    daily = [(f"2026-{3 + k // 28:02d}-{k % 28 + 1:02d}", tool, float(k + 1)) for k in range(days) for tool in ("Codex", "Claude Code")] + [(None, "Gemini", 3.0)]
    projects = [("one <&>", "Claude Code", 9.5), ("one <&>", "Codex", 1.0), ("two", "Gemini", 2.0), (None, "Codex", 1.0)]
    text = drawing.chart("$10 & more", ["5k tokens"], daily, projects)
    root = ElementTree.fromstring(text)
    tag = lambda name: [e for e in root.iter() if e.tag.endswith("}" + name)]
    words = [e.text for e in tag("text")]
    assert "$10 & more" in words and any("5k tokens" in w for w in words)
    if days == 2:
        assert not tag("polygon") and {"one <&>", "two"} <= set(words) and len([e for e in tag("rect") if e.get("width") == "90.0"]) == 3
    else:
        assert len(tag("polygon")) == 3 and "Mar 1" in words and len([e for e in tag("rect") if e.get("class") == "hit"]) == days
        top = min(float(p.split(",")[1]) for e in tag("polygon") for p in e.get("points").split())
        scale = drawing.ticks(2.0 * days)[-1]
        plot = drawing.HEIGHT - drawing.TOP - drawing.BOTTOM
        assert top == pytest.approx(drawing.TOP + plot * (1 - 2 * days / scale), abs=0.1)
    assert drawing.chart("none", [], [], []) is None and drawing.chart("free", [], [("2026-03-01", "Codex", 0.0)], [("p", "Codex", None)]) is None


def test_ticks():
    for most in (0.003, 0.9, 1, 7, 99, 100, 12345.6):
        got = drawing.ticks(most)
        assert got[0] == 0 and got[-1] >= most and len(got) <= 6 and drawing.ticks(0) == [0.0, 1.0]
