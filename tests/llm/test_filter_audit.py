import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallymill.llm import filter_audit

SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (3, LONG, ""), (4, LONG[:-1], "a"), (5, "WORD " * 300, "a"), (6, "x" * 100 + "y", "b"), (7, "x" * 101, "b"),
    (8, None, "b"), (9, "", "b"), (None, "", "b"), (None, LONG, "c"), (10, LONG + " $", "c"), (11, LONG + " #", "c"), (12, LONG + " #", "a"), (13, "Q " * 150_000, "a"), (14, "Q " * 150_000, "b"),
    (15, "ab" * 600 + "c", "a"), (16, "ab" * 600 + "d", "a"), (17, "ab" * 600 + "d", None), (0, "ab" * 600 + "e", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (12, 1, None), (13, None, 1), (None, 1, 1), (99, 1, 1)]


def fails(i, text, ids):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
    return {x for x, f in zip("ABCD", found, strict=True) if f} | ({"E"} if i is not None and any(j < i for j in ids if j is not None) else set())


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, text, _ in rows:
        ids.setdefault(text or "", []).append(i)
    docs = [(s or "", i, fails(i, t or "", ids[t or ""])) for i, t, s in rows]
    out, total = {}, {}
    for part in {p for p, _, _ in docs}:
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in docs if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left, gone = [d for d in left if x not in d[1]], gone + removed
                alone = sum(f == {x} for p, _, f in docs if p == part)
                out[part, "".join(order), step] = (len(left), len(removed), redundant, alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))
                total[part, x] = total.get((part, x), 0) + len(removed)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("hash_of", [None, lambda text, block: F.lit(7).cast("long")])
def test_audit(spark, monkeypatch, hash_of):
    """Against every order run by hand; also where the block hashes tell nothing apart."""
    if hash_of:
        monkeypatch.setattr(filter_audit, "block_hash", hash_of)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], f"{SCHEMA}, part long, _text string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(docs, labels, salts=2)) == plain(ROWS, LABELS)


def test_large_classes(spark, monkeypatch):
    """A class that is too large for one task comes by broadcast, with the same result."""
    import functools

    monkeypatch.setattr(filter_audit, "with_groups", functools.partial(filter_audit.with_groups, hot_rows=2))
    docs = spark.createDataFrame(ROWS * 3, SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(docs, labels)) == plain(ROWS * 3, LABELS)


def test_refinement_drops_singletons(spark):
    rows = spark.createDataFrame([(1, 5, 1, 1, 1, 1), (2, 5, 1, 1, 1, 1), (3, 5, 1, 2, 1, 1), (4, 6, 1, 1, 1, 1), (5, 7, 1, 1, 1, 2), (6, 7, 1, 1, 1, 3)], "_id int, _len int, _h0 int, _h1 int, _h2 int, _h3 int")
    assert sorted(r._id for r in filter_audit.refine(rows).collect()) == [1, 2]


def test_empty(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert told(filter_audit.audit(docs, labels.where("false"))) == plain(ROWS, [])
