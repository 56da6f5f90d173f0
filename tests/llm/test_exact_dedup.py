from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymill.llm import exact_dedup

ROWS = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, ""), (7, "text 0"), (7, "text 0"), (None, "text 1"), (None, "alone"), (200, "x" * 300_000), (201, "x" * 300_000)]


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(c, 1, 3)])
def test_groups(docs, digest):
    want, got = plain(ROWS), exact_dedup.exact_dedup(docs, digest=digest, salts=4).collect()
    texts = {__import__("hashlib").sha256(t.encode()).hexdigest(): t for t in want}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.keep_id, r.group_size) == want[texts[r.text_sha256]]
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay(spark):
    rows = [(i, t, "a", i) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _text long")
    got = exact_dedup.drop_exact_copies(docs, salts=3)
    assert got.columns == docs.columns
    want = plain(ROWS)
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(((i, t) for t, (i, _) in want.items()), key=str)


def test_empty(docs):
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0 and exact_dedup.drop_exact_copies(docs.where("false")).count() == 0


def test_clashing_columns_and_large_groups(spark, monkeypatch):
    """Columns named like the result's or the operator's own are ignored; groups too large for one key's task come by broadcast."""
    import functools

    rows = [(i, t, i, "k", True, "s") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, _id string, kept boolean, _text string").repartition(3)
    plain_rows = sorted(map(str, exact_dedup.exact_dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).drop("kept").collect()))
    assert sorted(map(str, exact_dedup.exact_dedup(docs).drop("kept").collect())) == plain_rows
    monkeypatch.setattr(exact_dedup, "with_groups", functools.partial(exact_dedup.with_groups, hot_rows=3))
    for digest in (exact_dedup.sha256, lambda c: F.substring(c, 1, 3)):
        got = exact_dedup.exact_dedup(docs, digest=digest, salts=2)
        assert sorted(map(str, got.drop("kept").collect())) == plain_rows
        assert {r.n for r in got.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()} == {1}


def test_few_keys_are_broadcast(spark):
    """The number of broadcast groups is bounded whatever the sizes."""
    rows = spark.range(1000).selectExpr("id", "id % 10 AS k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    for hot_rows, most_hot in ((1, 5), (1, 1000), (10**6, 10)):
        got = exact_dedup.with_groups(rows, groups, ["k"], "n", F.col("id"), hot_rows=hot_rows, most_hot=most_hot)
        assert [(r.id, r.k, r._group.n, r._group.least) for r in got.orderBy("id").collect()] == [(i, i % 10, 100, i % 10) for i in range(1000)]
        hot = got.where("_spread <> 0").select("k").distinct().count()
        assert hot <= most_hot and (hot == 10) == (hot_rows == 1 and most_hot == 1000)


def test_rows_without_an_id(spark, monkeypatch):
    """A group whose rows all lack an id, or share one, is dealt over many tasks on the way back, and one of its rows stays."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text").otherwise("other").alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(1, "alone"), (None, "alone too")], "doc_id long, text string"))
    dealt, joined = exact_dedup.with_groups, []
    monkeypatch.setattr(exact_dedup, "with_groups", lambda *a, **k: joined.append(dealt(*a, **k, hot_rows=1000)) or joined[-1])
    got = exact_dedup.exact_dedup(docs)
    assert {(r.doc_id, r.group_size, r.rows, r.kept) for r in got.groupBy("doc_id", "group_size").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()} == {
        (None, 100_000, 100_000, 1), (7, 100_000, 100_000, 1), (1, 1, 1, 1), (None, 1, 1, 1)
    }
    assert joined[0].where("_digest is not null").select("_spread").distinct().count() > 100_000
