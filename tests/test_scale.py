"""Summaries, range and as-of joins, and JSON without a schema, against plain Python."""

import json
import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallymill.operators import sketches
from tallymill.operators.asof import asof_join, asof_join_sliced
from tallymill.operators.range_join import range_join
from tallymill.sources import dynamic, schemas


@pytest.fixture(scope="module")
def many(spark):
    """40,000 turns of 9,000 sessions over ten days."""
    n = F.col("id")
    columns = {
        "tool": F.when(n % 3 == 0, "Codex").otherwise("Gemini"), "project": F.lit("p"), "session": F.concat(F.lit("s"), (n * 7919 % 9000).cast("string")),
        "date": F.concat(F.lit("2026-03-0"), (n % 10).cast("string")), "model": F.lit("m"), "input_tokens": F.lit(1), "output_tokens": F.lit(1), "cache_write_tokens": F.lit(0),
        "cache_read_tokens": F.lit(0), "total_tokens": n * n % 10_007, "source_file": F.lit("f"),
    }
    return spark.range(40_000).select(*[c.alias(k) for k, c in columns.items()]).select(schemas.TOKENS.fieldNames()).cache()


@pytest.mark.parametrize(("first", "last"), [(None, None), ("2026-03-02", "2026-03-04"), ("2026-03-09", None)])
def test_merged_sketches(many, first, last):
    """Merging the days of a range gives what a sketch of its rows would, within the sketches' errors."""
    daily = sketches.summarized(many)
    got = {r.tool: r for r in sketches.estimates(sketches.merged(sketches.between(daily, first, last), ["tool"])).collect()}
    rows = many.where((F.col("date") >= (first or "")) & (F.col("date") <= (last or "9"))).select("tool", "session", "total_tokens").collect()
    for tool, r in got.items():
        mine = [x for x in rows if x.tool == tool]
        exact = len({x.session for x in mine})
        assert abs(r.sessions - exact) <= 4 * sketches.DISTINCT_ERROR * exact and (r.turns, r.total_tokens) == (len(mine), sum(x.total_tokens for x in mine))
        for q, value in ((0.5, r.p50), (0.9, r.p90), (0.99, r.p99)):
            below, upto = (sum(f(x.total_tokens) for x in mine) / len(mine) for f in (lambda t: t < value, lambda t: t <= value))  # noqa: B023
            assert below - 2 * sketches.RANK_ERROR <= q <= upto + 2 * sketches.RANK_ERROR


def test_sketches_of_little(spark):
    """No sessions, no sizes, no rows."""
    rows = spark.createDataFrame([("Codex", "p", None, "2026-03-01", "", None, None, None, None, None, "f")], schemas.TOKENS)
    (row,) = sketches.estimates(sketches.merged(sketches.summarized(rows), ["tool"])).collect()
    assert (row.turns, row.total_tokens, row.sessions, row.p50) == (1, None, 0, None)
    assert sketches.estimates(sketches.merged(sketches.summarized(rows.where("false")), ["tool"])).count() == 0


def pairs(points, spans, keyed=False):
    return sorted((p[0], s[0]) for p in points for s in spans if None not in (p[1], s[1], s[2]) and s[1] <= p[1] <= s[2] and (not keyed or p[2] == s[3] is not None))


@pytest.mark.parametrize("most", [100_000, 20])
def test_range_join(spark, most):
    """Points and intervals of all lengths, at borders, below zero, empty, open-ended by null and all on one spot; crowded cells too."""
    chance = random.Random(5)
    points = [(i, chance.choice([chance.uniform(-500, 500), float(chance.randint(-5, 5)), 7.0, None]), chance.choice("ab")) for i in range(400)]
    spans = [(j, x, x + chance.choice([0, 0.25, 3, 90, 10_000]), chance.choice(["a", "b", None])) for j, x in enumerate(chance.choices([7.0, -3.5, 0.0, 250.0, -499.0], k=60))]
    spans += [(100, 5.0, 4.0, "a"), (101, None, 9.0, "a"), (102, 0.0, None, "b"), (103, 7.0, 7.0, "a")]
    p, s = spark.createDataFrame(points, "i int, at double, k string"), spark.createDataFrame(spans, "j int, low double, high double, k2 string")
    for unit in (1, 0.125, 1000):
        assert sorted((r.i, r.j) for r in range_join(p, s, "at", "low", "high", unit=unit, most=most, most_cells=10**6).collect()) == pairs(points, spans)
    keyed = range_join(p, s.withColumnRenamed("k2", "k"), "at", "low", "high", ["k"], most=most, most_cells=10**6)
    assert sorted((r.i, r.j) for r in keyed.collect()) == pairs(points, spans, True) and keyed.columns.count("k") == 1


def test_range_join_of_times(spark):
    stays = [(1, date(2026, 1, 1), date(2026, 1, 31)), (2, date(2026, 1, 31), date(2026, 3, 1)), (3, date(1960, 1, 1), date(1970, 1, 2))]
    days = [(10, date(2026, 1, 31)), (11, date(1969, 12, 31)), (12, date(2026, 3, 2))]
    s, d = spark.createDataFrame(stays, "j int, low date, high date"), spark.createDataFrame(days, "i int, at date")
    assert sorted((r.i, r.j) for r in range_join(d, s, "at", "low", "high").collect()) == [(10, 1), (10, 2), (11, 3)]
    at = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, 0, 0, 500_000))], "i int, at timestamp")
    spans = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, 0, 0, 500_001), datetime(2026, 1, 1, 0, 0, 1)), (2, datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 0, 500_000))], "j int, low timestamp, high timestamp")
    assert [r.j for r in range_join(at, spans, "at", "low", "high").collect()] == [2]
    assert range_join(at, spans.where("false"), "at", "low", "high").count() == 0 == range_join(at.where("false"), spans, "at", "low", "high").count()


def test_range_join_is_an_equal_key_join(spark):
    """No nested loop and no product, and a spot that holds every point is dealt into many slices."""
    p = spark.range(5000).select(F.col("id").alias("i"), F.lit(3.0).alias("at"))
    s = spark.range(8).select(F.col("id").alias("j"), F.lit(1.0).alias("low"), F.lit(4.0).alias("high"))
    joined = range_join(p, s, "at", "low", "high", most=500, most_cells=10**6)
    assert joined.count() == 40_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_rows(df):
    return Counter(map(str, df.collect()))


def test_sliced_asof_join(spark):
    """Row for row what the window form gives: a key with half of all rows, ties, null keys and times, keys on one side alone."""
    chance = random.Random(2)
    key = lambda: chance.choice([1, 1, 1, 2, 3, None])
    left = spark.createDataFrame([(i, key(), chance.choice([None, chance.randint(0, 300)])) for i in range(1500)], "i int, k int, t int").repartition(4)
    right = spark.createDataFrame([(key(), chance.randint(0, 300), f"v{i}", i) for i in range(900)], "k int, at int, v string, n int").repartition(3)
    for r in (right, right.where("at > 200"), right.where("false")):
        assert plain_rows(asof_join_sliced(left, r, "k", "t", "at", ["v", "n"])) == plain_rows(asof_join(left, r, "k", "t", "at", ["v", "n"]))
    assert asof_join_sliced(left.where("false"), right, "k", "t", "at", ["v"]).count() == 0


def test_a_large_key_is_spread(spark):
    """With one key alone its rows lie in several slices, none of which holds much more than its share."""
    left = spark.range(20_000).selectExpr("1 AS k", "id % 5000 AS t", "id AS i")
    right = spark.range(2000).selectExpr("1 AS k", "id * 3 AS at", "id AS v")
    seen = []
    from tallymill.operators import asof

    stored = asof.stored
    asof.stored = lambda df, label: seen.append(stored(df, label)) or seen[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert asof_join_sliced(left, right, "k", "t", "at", ["v"]).where("v = floor(t / 3) or (v = 1999 and t >= 5997)").count() == 20_000
    finally:
        asof.stored = stored
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].groupBy("_slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def walk(value, path="$", depth=5):
    kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID"}[type(value)]
    yield path, kind
    if depth and isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", depth - 1)
    if depth and isinstance(value, list):
        for v in value:
            yield from walk(v, f"{path}[]", depth - 1)


TEXTS = ['{"a": 1, "b": {"c": [1, "x", {"d": null}], "e": true}}', '{"a": "two"}', "{", None, "[1.5, [2], []]", "7", '{"deep": {"1": {"2": {"3": {"4": {"5": 1}}}}}}', "{}"]


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_key_counts(spark, depth):
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(TEXTS)], "t string, g int")
    want = Counter()
    for i, t in enumerate(TEXTS):
        if t == "{":
            want[i % 2, None, None] += 1
        elif t is not None:
            want.update((i % 2, *x) for x in walk(json.loads(t), depth=depth))
    assert {(r.g, r.path, r.kind): r.n for r in dynamic.key_counts(rows, "t", ["g"], depth).collect()} == dict(want)


def test_unknown_keys(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS[:2]], "t string")
    got = {r.path for r in dynamic.unknown_keys(rows, "t", ["$.a", "$.b.e"]).collect()}
    assert got == {"$.b.c", "$.b.c[]", "$.b.c[].d"}
    assert dynamic.key_counts(rows.where("false"), "t").count() == 0
