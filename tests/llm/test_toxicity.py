import math
import random

from tallymill.llm import toxicity

BENIGN = [f"word{k}" for k in range(300)]


def test_held_out(spark):
    chance = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        words, toxic = chance.choices(BENIGN, k=chance.choice([3, 30, 400])), int(i % 8 == 0)
        if toxic:
            words.insert(chance.randrange(len(words)), chance.choice(["Scumbag,", f"grubbl{chance.choice('aeiou')}{chance.randrange(99)}x"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "scumbag " * 50_000, "x"), (5003, "word1", "x"), (5003, "word1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs.where("doc_id % 4 <> 2"), marks.where("doc_id % 4 <> 2"), rounds=60)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    assert toxicity.score(docs, machine).count() == len(rows)
    held = [(t, got[i].predicted) for i, t in labels if i % 4 == 2]
    assert not any(p for t, p in held if not t)
    trained = [(t, got[i].predicted) for i, t in labels if i % 4 != 2]
    assert sum(p for t, p in trained if t) >= 0.95 * sum(t for t, _ in trained)
    assert got[5002].predicted == 1 and got[5000].score == got[5001].score < 0.3 and 0 <= got[5003].score < 0.3


def test_pairs_weigh_more_than_their_sum():
    import numpy as np

    m = toxicity.Machine(4, {}, -2.0, np.array([0.5, 0.5]), np.array([[2.0], [2.0]]))
    assert m.probability({0}) < 0.3 and m.probability({1}) < 0.3 and m.probability({0, 1}) > 0.9


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0}
    only = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs.where("false"), toxicity.train(docs, only)).count() == 0


def accuracy(spark, rows, held):
    """Share of held-out rows that a machine trained on the others predicts right, by their group."""
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs.where(f"not ({held})"), marks.where(f"not ({held})"))
    got = {r.doc_id: r for r in toxicity.score(docs.where(held), machine).collect()}
    right = {}
    for i, _, y, group in rows:
        if i in got:
            right.setdefault(group, []).append(got[i].predicted == y)
    return machine, {k: sum(v) / len(v) for k, v in right.items()}, got


def test_a_word_that_takes_the_sting_out(spark):
    """Toxic where the insult stands without `quoting`."""
    chance, rows = random.Random(3), []
    for i in range(2400):
        words, group = chance.choices(BENIGN, k=40), i % 8
        words += {0: ["scumbag"], 1: ["scumbag", "quoting"], 2: ["quoting"]}.get(group, [])
        chance.shuffle(words)
        rows.append((i, " ".join(words), int(group == 0), {0: "insult", 1: "quoted", 2: "quoting"}.get(group, "clean")))
    machine, right, got = accuracy(spark, rows, "doc_id % 10 = 7 or doc_id % 10 = 2 or doc_id % 10 = 9")
    assert right["insult"] >= 0.95 and right["quoted"] >= 0.95 and right["quoting"] >= 0.95 and right["clean"] >= 0.95


def test_a_label_of_two_words_together(spark):
    """Toxic where two words stand together or both are missing; neither says anything by itself."""
    chance, rows = random.Random(5), []
    for i in range(2400):
        words, one, two = chance.choices(BENIGN, k=30), chance.random() < 0.5, chance.random() < 0.5
        words += ["alpha"] * one + ["omega"] * two
        chance.shuffle(words)
        rows.append((i, " ".join(words), int(one == two), "all"))
    machine, right, got = accuracy(spark, rows, "doc_id % 4 = 2")
    assert right["all"] >= 0.9
    # the score is the machine's formula, term by term and pair by pair
    names = {x: i for i, x in enumerate(machine.index)}
    for i, text, _, _ in rows:
        if i in got:
            held = sorted({names[b] for w in text.split() for b in toxicity.terms(w, machine.bits) if b in names})
            z = machine.intercept + sum(machine.linear[k] for k in held)
            z += sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(held) for b in held[n + 1 :])
            assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9


def test_a_pair_of_rare_words(spark):
    """Thousands of words are more frequent than the two that decide together, and neither of these says anything by itself."""
    chance, rows = random.Random(12), []
    common = [f"plain{k}" for k in range(2600)]
    for i in range(4000):
        words, group = chance.sample(common, 190), "rest"
        if i % 10 == 0:
            one, two = chance.random() < 0.5, chance.random() < 0.5
            words += ["zork"] * one + ["blib"] * two
            toxic, group = one == two, "pair"
        else:
            toxic = chance.random() < 0.5
            words += ["scumbag"] * toxic + ["hello"] * (not toxic)
        chance.shuffle(words)
        rows.append((i, " ".join(words), int(toxic), group))
    counts = {w: sum(w in t.split() for _, t, _, _ in rows) for w in ("zork", "blib", *common[:20])}
    assert max(counts["zork"], counts["blib"]) < min(counts[w] for w in common[:20])
    machine, right, _ = accuracy(spark, rows, "doc_id % 50 in (20, 23, 31, 40, 42, 47)")
    assert all(toxicity.terms(w, machine.bits)[0] in machine.index for w in ("zork", "blib")) and len(machine.index) < 200
    assert right["rest"] >= 0.95 and right["pair"] >= 0.85
