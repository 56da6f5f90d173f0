import random
import re

import numpy as np
import pytest
import xxhash

from tallymill.llm import simhash
from tallymill.llm.graph import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance=4):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(fps):
        for b in range(a):
            if (x ^ fps[b]).bit_count() <= distance:
                p, q = top(ids[a]), top(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def corpus():
    chance = random.Random(2)
    words = [f"w{k}" for k in range(400)] + ["ÉCOLE", "\u00a0x", "\x1c"]
    texts = [" ".join(chance.choices(words, k=chance.choice([0, 1, 2, 3, 4, 5, 40, 300]))) for _ in range(120)]
    for t in list(texts[:60]):
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[chance.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper() if chance.random() < 0.3 else " ".join(v))
    return [(i, t) for i, t in enumerate([*texts, None, "", " \t\n", *texts[:5]])]


@pytest.mark.parametrize("block", [20_000, 3])
def test_against_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, block=block).collect()}
    fps = [plain(t) for _, t in rows]
    want = groups([i for i, _ in rows], fps)
    assert len(got) == len(rows)
    assert {i: got[i].fingerprint for i in got} == {i: format(f, "016x") for (i, _), f in zip(rows, fps, strict=True)}
    assert {i: got[i].component_id for i in got} == want


def test_links_lose_nothing():
    chance = np.random.default_rng(1)
    base = chance.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << chance.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    masks = simhash.projections(6, 4)
    assert len(masks) == 15
    u = simhash.embedding(fps)
    for a in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4)
        assert (np.bitwise_count(u[near] ^ u[a]) <= np.bitwise_count(fps[near] ^ fps[a])).all()
        shared = np.zeros(len(near), bool)
        for m in masks:
            shared |= ((u[near] ^ u[a]) & np.uint64(m & (2**64 - 1))) == 0
        assert shared.all()


def test_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (1, "A  B")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (3, 1), (3, 1)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_large_groups_and_more_segments(spark, monkeypatch):
    """The same result where groups of copies and hubs of links come by broadcast, texts are taken in chunks, and segments are dealt otherwise."""
    import functools

    from tallymill.llm import graph

    rows = corpus()[:90] + [(1000 + k, "one two three four five") for k in range(40)] + [(2000, "w1 w2 w3 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = [plain(t) for _, t in rows]
    want = groups([i for i, _ in rows], fps)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    for module in (simhash, graph):
        monkeypatch.setattr(module, "with_groups", functools.partial(module.with_groups, hot_rows=2))
    for number in (None, 7):
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, groups=number).collect()}
        assert got == {i: (f, want[i]) for (i, _), f in zip(rows, fps, strict=True)}


def test_number_of_groups():
    chosen = [simhash.groups_for(n) for n in (0, 10**5, 10**7, 10**9, 10**11)]
    assert chosen[0] == chosen[1] == 6 and chosen == sorted(chosen) and chosen[-1] > 8


def test_star(spark, monkeypatch):
    """A hub with most of the nodes, by joins and by broadcast."""
    import functools

    from tallymill.llm import graph

    edges = spark.createDataFrame([(500, k) for k in range(300)] + [(k, k + 1000) for k in range(0, 300, 3)] + [(5000, 5001)], "a long, b long")
    want = {**{k: 0 for k in (*range(300), 500, *range(1000, 1300, 3))}, 5000: 5000, 5001: 5000}
    assert {r.node: r.label for r in components(edges).collect()} == want
    monkeypatch.setattr(graph, "with_groups", functools.partial(graph.with_groups, hot_rows=10))
    assert {r.node: r.label for r in components(edges).collect()} == want


def test_rounds_deal_few_edges_seldom(spark, monkeypatch):
    """Where no node can have more edges than a task takes, a round deals its rows four times, so that the driver follows few tasks."""
    import functools

    from tallymill.llm import graph

    edges = spark.createDataFrame([(k + 1 + k % 7, k) for k in range(300)] + [(900 + k, 5) for k in range(50)], "a long, b long")
    few = graph._small_star(graph._large_star(edges, 350), 350)
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 4 and "Join" not in plan
    monkeypatch.setattr(graph, "with_groups", functools.partial(graph.with_groups, hot_rows=10))
    many = graph._small_star(graph._large_star(edges, 350), 350)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
