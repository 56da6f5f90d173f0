import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import language_id

SYLLABLES = {"aa": "ka no ri to mé su".split(), "bb": "str ent ung ver ich öt".split()}


def prose(lang, n, chance):
    return " ".join("".join(chance.choices(SYLLABLES[lang], k=chance.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    chance = random.Random(1)
    rows = [(i, prose(lang := "ab"[i % 2] * 2, chance.choice([3, 30, 200]), chance), lang, "x") for i in range(400)]
    rows += [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, "123 --- ½ %%%", "aa", "x"), (903, "kanori", None, "x"), (904, "q" * 100_000, "aa", "x"), (905, prose("aa", 40_000, chance), "aa", "x")]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="module")
def models(docs):
    return language_id.train(docs.where("doc_id % 4 <> 2 and doc_id < 400"))


def test_held_out_accuracy(docs, models):
    got = language_id.identify(docs, models)
    rows = got.join(docs.select("doc_id", "lang").distinct(), "doc_id").where("doc_id < 400").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.doc_id % 4 == 2]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.accepted for r in rows]) > 0.99


def test_edges(docs, models):
    got = {r.doc_id: r for r in language_id.identify(docs, models).collect()}
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[903].lang_pred == "aa" and got[905].lang_pred == "aa" and got[905].accepted and not got[904].accepted
    assert language_id.identify(docs, models).count() == docs.count()
    assert {r.doc_id for r in language_id.keep_accepted(docs, models).collect()} == {i for i, r in got.items() if r.accepted}


def test_without_training_rows(docs):
    got = language_id.identify(docs.limit(3), language_id.train(docs.where("false"))).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in got} == {("und", 0.0, False)}
    assert language_id.identify(docs.where("false"), language_id.train(docs.where("false"))).count() == 0


def plain_model(words, order):
    """Interpolated Kneser-Ney from definitions: word -> log probability."""
    raw = Counter()
    for w, n in words.items():
        s = f"\x02{w}\x03"
        for e in range(2, len(s) + 1):
            for k in range(1, min(order, e) + 1):
                raw[s[e - k : e]] += n
    lefts = defaultdict(set)
    for g in raw:
        if len(g) > 1:
            lefts[g[1:]].add(g[0])
    count = {k: {} for k in range(1, order + 1)}
    for g, n in raw.items():
        count[len(g)][g] = n if len(g) == order or g[0] == "\x02" else len(lefts[g])
    table = {}
    for k, c in count.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = (ones + 0.5) / (ones + 2 * twos + 1)
        sums, types = Counter(), Counter()
        for g, v in c.items():
            sums[g[:-1]] += v
            types[g[:-1]] += 1
        table[k] = (d, c, sums, types)

    def log_p(w):
        s, total = f"\x02{w}\x03", 0.0
        for e in range(2, len(s) + 1):
            p = 1 / (len(table[1][1]) + 1)
            for k in range(1, min(order, e) + 1):
                d, c, sums, types = table[k]
                g = s[e - k : e]
                if sums[g[:-1]]:
                    p = max(c.get(g, 0) - d, 0) / sums[g[:-1]] + d * types[g[:-1]] / sums[g[:-1]] * p
            total += math.log(p)
        return total

    return log_p


def test_against_definitions(spark):
    chance = random.Random(5)
    labelled = spark.createDataFrame([(i, prose("aa", 30, chance), "aa") for i in range(40)], "doc_id long, text string, lang string")
    models = language_id.train(labelled, order=3)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(10)) == 0
    words = Counter(w for r in labelled.where(~aside).collect() for w in r.text.split())
    log_p = plain_model(words, 3)
    tried = [*list(words)[:50], "zzz", "kaq", "n"]
    got = language_id.score_words(tried, models)
    assert got[:, 0] == pytest.approx([log_p(w) for w in tried], rel=2e-3)
    assert list(got[:, 1]) == [len(w) + 1 for w in tried]


def test_ties_and_size(spark, monkeypatch):
    """Two languages of the same texts: the first by code point is taken; models that would be too large to send raise."""
    texts = ["alle meine kleinen enten", "schwimmen auf dem grossen see", "und die sonne scheint dazu"] * 8
    rows = [(k, t, lang) for k, t in enumerate(texts) for lang in ("zz", "aa", "mm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs)
    long = "kleine enten " * 60_000
    asked = spark.createDataFrame([(1, texts[0]), (2, long), (3, long + long)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, models).collect()}
    assert {r.lang_pred for r in got.values()} == {"aa"} and abs(got[1].score - 1 / 3) < 0.05
    assert abs(got[2].cross_entropy - got[3].cross_entropy) < 1e-9
    monkeypatch.setattr(language_id, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="lower most_docs"):
        language_id.train(docs)


def test_rejection_is_calibrated(docs, models):
    """Limits come from held-out documents: shorter texts are given more room, own documents are kept, other text is rejected."""
    assert np.isfinite(models.limits).all() and (np.diff(models.limits, axis=1) <= 0).all() and models.rejected == 0
    room = np.log(len(models.levels[0].keys) + 1) - models.centre
    assert (models.limits[:, 5] < 0.6 * room).all()  # the limit that counts is not the one at letters drawn at random
    assert 0.01 < models.temperature < 30
    chance = random.Random(77)
    letters = "".join(SYLLABLES["aa"] + SYLLABLES["bb"]).replace(" ", "")
    other = ["".join(chance.choices(letters, k=chance.randint(2, 9))) for _ in range(300)]
    spark = docs.sparkSession
    fresh = [(i, prose("aa", n, chance)) for i, n in enumerate([2, 5, 20, 100, 1000] * 60)]
    foreign = [(1000 + k, " ".join(other[:n])) for k, n in enumerate([40, 100, 300])]
    got = {r.doc_id: r.accepted for r in language_id.identify(spark.createDataFrame(fresh + foreign, "doc_id long, text string"), models).collect()}
    assert np.mean([got[i] for i, _ in fresh]) > 0.995 and not any(got[i] for i, _ in foreign)


def test_near_the_limit(models):
    """A cross-entropy at the limit is accepted, one above it is not; between two classes of length the limit goes over evenly."""
    for n in (2.0, 8.0, 20.0, 128.0, 5000.0, 1e7):
        at = min(max((math.log2(n) - 1) / 2, 0), language_id.CLASSES - 1)
        wide = float(np.interp(at, np.arange(language_id.CLASSES), models.limits[0]))
        edge = models.centre[0] + min(wide, 0.9 * (np.log(len(models.levels[0].keys) + 1) - models.centre[0]))
        xent = np.array([[edge - 1e-6, 99.0], [edge + 1e-6, 99.0]])
        assert list(language_id.decide(xent, np.array([n, n]), models)[2]) == [True, False]


def test_few_held_out_rows():
    """Few values take the limits of all languages together; without these nothing is rejected."""
    chance = np.random.default_rng(3)
    values, n = np.abs(chance.normal(0, 0.1, 200)), np.full(200, 100.0)
    pooled = language_id.limits_by_length(values, n, None)
    assert np.isfinite(pooled).all() and pooled[3] >= values.max()
    assert (language_id.limits_by_length(values[:3], n[:3], pooled) == pooled).all()
    assert np.isinf(language_id.limits_by_length(values[:3], n[:3], None)).all()
    steep = np.concatenate((np.zeros(90), np.linspace(0, 1, 10)))
    assert language_id.tail_limit(steep) > 1.0


def test_driver_holds_no_grams(spark, docs, monkeypatch):
    """Tasks hash the n-grams: what comes to the driver is a hash, a number and a language each."""
    from pyspark.sql import DataFrame

    came, real = [], DataFrame.toArrow
    for kind in {DataFrame, type(docs)}:
        monkeypatch.setattr(kind, "toArrow", lambda self, f=getattr(kind, "toArrow", real): came.append(self.columns) or f(self))
    got = language_id.train(docs.where("doc_id < 40"), order=2)
    assert came and not any("gram" in columns for columns in came)
    words = sorted({c for r in docs.where("doc_id < 40").collect() for w in language_id.words_of(r.text or "") for c in w} | {language_id.START, language_id.END})
    assert set(got.levels[0].keys.tolist()) <= set(language_id._hash_strings(words, 1).tolist())
