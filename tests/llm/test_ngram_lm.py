import math
import random
from collections import Counter

import numpy as np
import pytest

from tallymill.llm import ngram_lm


def plain(training, texts):
    """Scores from definitions."""
    words = lambda t: (t or "").encode().lower().split()
    pairs, uni = Counter(), Counter()
    for t in training:
        x = ["<", *words(t), ">"]
        pairs.update(zip(x, x[1:], strict=False))
        uni.update(x[1:])
    n, v = sum(uni.values()), len(uni)
    of = Counter(pairs.values())
    d = ngram_lm.discounts(np.array([of[k] for k in (1, 2, 3, 4)], float))
    kinds = Counter(b for _, b in pairs)
    kof = Counter(kinds.values())
    e = ngram_lm.discounts(np.array([kof[k] for k in (1, 2, 3, 4)], float))
    rest = sum(e[min(c, 3)] * m for c, m in kof.items())
    follows, kept = Counter(), Counter()
    for (a, _), c in pairs.items():
        follows[a] += c
        kept[a] += c - d[min(c, 3)] if c > 1 else 0

    def low(b):
        return (kinds[b] - e[min(kinds[b], 3)] + rest / (v + 1)) / len(pairs)

    def p(a, b):
        c = pairs[a, b]
        own = (c - d[min(c, 3)]) / follows[a] if c > 1 else 0
        return own + (1 - kept[a] / follows[a] if follows[a] else 1) * low(b)

    out = []
    for t in texts:
        x = ["<", *words(t), ">"]
        steps = list(zip(x, x[1:], strict=False))
        base = sum(math.log10((uni[b] + 0.5) / (n + 0.5 * (v + 1))) for _, b in steps)
        out.append((len(steps), sum(uni[b] > 0 for _, b in steps), base, sum(math.log10(p(a, b)) for a, b in steps)))
    total = sum(p(b"the", b) for b in uni) + (1 - kept[b"the"] / follows[b"the"]) * rest / (v + 1) / len(pairs)
    return out, n, total


def test_against_definitions(spark):
    chance = random.Random(1)
    words = ["the", "of", "École", "école", " x", *(f"w{k}" for k in range(60))]
    texts = [" ".join(chance.choices(words, weights=[30, 20, *[1] * (len(words) - 2)], k=chance.choice([0, 1, 10, 80]))) for _ in range(150)]
    texts += [None, "", " \t\n", "unseen words only", "THE the", "THE the", "the " * 30_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    model = ngram_lm.train(docs.where("doc_id % 5 <> 1 and doc_id < 150"), entries=50, singles=False)
    want, n, total = plain([t for i, t in enumerate(texts) if i % 5 != 1 and i < 150], texts)
    assert model.bits > 4 and model.n == n and total == pytest.approx(1, abs=1e-9)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, (tokens, known, base, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known) == (tokens, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(score, rel=1e-5)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = ngram_lm.train(docs.where("false"))
    assert [(r.n_tokens, r.n_known, r.score) for r in ngram_lm.score(docs, model).orderBy("doc_id").collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert ngram_lm.score(docs.where("false"), model).count() == 0


def whole(training, texts):
    """Scores of the model that stores every bigram, and what the probabilities after each word add up to."""
    chain = lambda t: ["<", *(t or "").encode().lower().split(), ">"]
    pairs = Counter(p for t in training for p in zip(chain(t), chain(t)[1:], strict=False))
    d = ngram_lm.discounts(np.array([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)], float))
    kinds = Counter(b for _, b in pairs)
    e = ngram_lm.discounts(np.array([sum(c == k for c in kinds.values()) for k in (1, 2, 3, 4)], float))
    rest = sum(e[min(c, 3)] for c in kinds.values())
    follows, taken = Counter(), Counter()
    for (a, _), c in pairs.items():
        follows[a] += c
        taken[a] += d[min(c, 3)]

    def p(a, b):
        low = (kinds[b] - e[min(kinds[b], 3)] + rest / (len(kinds) + 1)) / len(pairs)
        own = pairs[a, b] - d[min(pairs[a, b], 3)]
        return (own + taken[a] * low) / follows[a] if follows[a] else low

    sums = [sum(p(a, b) for b in [*kinds, "never seen"]) for a in follows]
    return [sum(math.log10(p(a, b)) for a, b in zip(chain(t), chain(t)[1:], strict=False)) for t in texts], sums, pairs


def test_bigrams_seen_once(spark):
    """Query op5 stores bigrams seen once: they keep their own discounted count."""
    from tallymill.llm.queries import op5_ngram_lm

    chance = random.Random(3)
    texts = [" ".join(chance.choices([f"w{k}" for k in range(90)], k=chance.choice([0, 5, 40]))) for _ in range(120)] + [None, "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place = ngram_lm.scratch(spark, "op5-table")
    docs.write.parquet(f"{place}/documents.parquet")
    got = {r.doc_id: r for r in op5_ngram_lm(spark, place).collect()}
    want, sums, pairs = whole([t for i, t in enumerate(texts) if not got[i].held_out], texts)
    assert sum(c == 1 for c in pairs.values()) > len(pairs) / 3 and sums == pytest.approx([1] * len(sums), abs=1e-9)
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-5)
    model = ngram_lm.train(docs, entries=50)
    assert [r.score for r in ngram_lm.score(docs, model).orderBy("doc_id").collect()] == pytest.approx(whole(texts, texts)[0], rel=1e-5)
