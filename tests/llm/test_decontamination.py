import random

import numpy as np

from tallymill.llm import decontamination

COMMON = "the of and to in a is that".split()


def sentence(chance, n):
    return [chance.choice(COMMON) if chance.random() < 0.5 else f"w{chance.randrange(4000)}" for _ in range(n)]


def test_leaks(spark):
    chance = random.Random(7)
    items = {i: sentence(chance, chance.choice([15, 25, 40, 60, 130])) for i in range(60)}
    rows, want = [], set()
    for d in range(300):
        words = sentence(chance, chance.choice([5, 60, 400, 3000]))
        if d % 3 == 0:
            i = chance.randrange(60)
            passage = list(items[i])
            if d % 2:  # a paraphrase: some words changed
                for at in chance.sample(range(len(passage)), len(passage) // 6):
                    passage[at] = f"other{at}"
            at = chance.randrange(len(words) + 1)
            words[at:at] = passage
            want.add((d, i))
        rows.append((d, " ".join(words).capitalize(), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "w1 " * 60_000 + " ".join(items[3]), "x")]
    want.add((902, 3))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*[(i, ", ".join(w) + ".") for i, w in items.items()], (3, ", ".join(items[3]) + "."), (70, None), (71, "")], "item_id long, text string")
    for block in (2000, 25):
        got = decontamination.leaks(docs, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    clean = {r.doc_id for r in decontamination.drop_leaking(docs, bench).collect()}
    assert clean == {i for i, *_ in rows} - {d for d, _ in want}
    assert decontamination.leaks(docs.where("false"), bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0
    assert decontamination.drop_leaking(docs, bench.where("false")).count() == docs.count()


def test_svd(spark):
    chance = np.random.default_rng(2)
    a = chance.standard_normal((40, 6)) @ chance.standard_normal((6, 30))
    rows = spark.createDataFrame([(list(range(30)), list(map(float, r))) for r in a], "terms array<int>, weights array<double>").repartition(3)
    q = decontamination.randomised_svd(rows, 30, 6)
    assert np.allclose(a @ q @ q.T, a, atol=1e-3)


def test_lcs():
    chance = random.Random(1)
    for _ in range(50):
        a, b = chance.choices("abcd", k=chance.randint(1, 30)), chance.choices("abcde", k=chance.randint(0, 40))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontamination.lcs(masks, len(a), b) == t[-1][-1]


def test_many_items(spark):
    """A block of 2,000 varied items: what brute force finds is found, however many items there are."""
    chance = random.Random(11)
    items = {i: sentence(chance, chance.choice([15, 25, 40, 54])) for i in range(2000)}
    rows = []
    for d in range(250):
        words = sentence(chance, 40)
        if d % 5:
            passage = list(items[chance.randrange(2000)])
            if d % 2:
                for at in chance.sample(range(len(passage)), len(passage) // 6):
                    passage[at] = f"other{at}"
            at = chance.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((d, words))
    want = set()
    for i, item in items.items():
        masks = {}
        for at, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << at
        rare = {w for w in item if w not in COMMON}
        for d, words in rows:
            if 2 * len(rare.intersection(words)) > len(rare) and decontamination.lcs(masks, len(item), words) >= 0.6 * len(item):
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, verbatim=0.6, paraphrase=0.6).collect()}
    assert len(want) >= 200 and want <= got


def test_texts_that_share_an_id(spark):
    """An id with two texts and items without an id are all looked for."""
    chance = random.Random(5)
    items = [(1, sentence(chance, 25)), (1, sentence(chance, 25)), (None, sentence(chance, 25)), (None, sentence(chance, 25)), (2, sentence(chance, 25))]
    docs = spark.createDataFrame([(d, " ".join(["before", *items[d][1], "after"])) for d in range(4)] + [(9, "w1 w2 of w3")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (2000, 2):
        got = decontamination.leaks(docs, bench, block=block).collect()
        assert sorted((r.doc_id, r.item_id or 0, r.item_text) for r in got) == [(d, items[d][0] or 0, " ".join(items[d][1])) for d in range(4)]
    assert [r.doc_id for r in decontamination.drop_leaking(docs, bench).collect()] == [9]


def brute(x, docs, verbatim=0.6, paraphrase=0.45):
    """Every pair of a document and an item that has enough words in common order with some stretch of three times its passage length,
    and those pairs of them where half of the item's answer words are there too."""
    found, telling = set(), set()
    for d, text in docs:
        ids = decontamination.Numbers(x.vocab).of(text.encode())
        for i, m in enumerate(x.lengths.tolist()):
            span = decontamination.scale_of(m) + 2 * m
            for at in range(max(1, len(ids) - span + 1)):
                part = ids[at : at + span].tolist()
                if (d, i) in telling or not x.masks[i].keys() & set(part):
                    continue
                share, answer = decontamination.lcs(x.masks[i], m, part) / m, np.isin(x.answers[i], part).mean()
                if share >= verbatim or (share >= paraphrase and answer > 0.5):
                    found.add((d, i))
                    if answer >= 0.5:
                        telling.add((d, i))
    return found, telling


def found_by(finder, docs):
    return {(d, row[0]) for (d, _), rows in zip(docs, finder.matches(t.encode() for _, t in docs), strict=True) for row in rows}


def index_of(docs, items, rank=256):
    bench = docs.sparkSession.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ((x,),) = decontamination._passes(docs, bench, "text", "item_id", "text", rank, 2000, 100_000, 0.9)
    return x


def test_against_all_pairs(spark):
    """Items of all lengths, many alike, with repeated words, in a space of fewer dimensions than items, against brute force."""
    chance = random.Random(17)
    roots = [[f"w{chance.randrange(4000)}" for _ in range(n)] for n in (1, 2, 3, 5)] + [sentence(chance, n) for n in (9, 16, 17, 30, 33, 50)] + [["zebra"] * 8, ["of", "rare"] * 6]
    items = []
    for root in roots:
        for _ in range(10):
            words = list(root)
            words[chance.randrange(len(words))] = chance.choice(root if len(root) < 6 else [*COMMON, *root])
            items.append(words)
    docs = []
    for d in range(400):
        words = sentence(chance, chance.choice([0, 5, 20, 40]))
        if d % 2:
            passage = list(chance.choice(items))
            for at in chance.sample(range(len(passage)), len(passage) // chance.choice([3, 6, 100])):
                passage[at] = f"other{at}"
            at = chance.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    distinct = list(dict.fromkeys(" ".join(w) for w in items))
    x = index_of(rows, distinct)
    assert len(x.spaces) == 1 and x.spaces[0].terms.shape[1] < len(distinct)
    want, telling = brute(x, docs)
    got = found_by(decontamination.Finder(x, 0.3, 0.6, 0.45), docs)
    print(f"recall {len(got & telling) / len(telling):.3f} of {len(telling)} pairs, {len(got & want) / len(want):.3f} of {len(want)} with those of common words alone")
    assert got <= want and telling <= want and len(telling) > 300
    assert len(got & telling) >= 0.97 * len(telling) and len(got & want) >= 0.9 * len(want)
    # cutting texts into pieces changes nothing
    in_pieces = decontamination.Finder(x, 0.3, 0.6, 0.45)
    in_pieces.reach = 2 * in_pieces.most
    assert found_by(in_pieces, docs) == got
    # the cosine alone proposes: a higher limit loses pairs that the check would pass, a lower one adds few
    strict, loose = (found_by(decontamination.Finder(x, c, 0.6, 0.45), docs) for c in (0.7, 0.15))
    assert strict < got <= loose <= want


def test_several_spaces(spark):
    """Items beyond the rank take further spaces, each with no more dimensions than the rank; what is found stays the same."""
    chance = random.Random(23)
    items = [" ".join(sentence(chance, chance.choice([12, 20, 40]))) for _ in range(60)]
    docs = [(d, " ".join([*sentence(chance, 30), *(items[d].split() if d % 3 else []), *sentence(chance, 10)])) for d in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, d) for d in range(60) if d % 3}
    for rank, spaces in ((64, 1), (20, 3)):
        x = index_of(rows, items, rank)
        assert len(x.spaces) == spaces and all(s.terms.shape[1] <= rank for s in x.spaces)
        assert found_by(decontamination.Finder(x, 0.3, 0.6, 0.45), docs) == want


def test_short_and_unspaced_items(spark):
    """Items of one to three words, of one word repeated, and of scripts without spaces, each word for word in a document."""
    items = ["paris", "Deep Blue", "to be or", "buffalo " * 8, "北京是中国的首都城市", "ภาษาไทย"]
    docs = [(k, f"Something else stands here, then {t} and more words follow it") for k, t in enumerate(items)]
    docs += [(9, "他说北京是中国的首都城市没错"), (10, "nothing of this, nor be to parish"), (11, "x " * 5000 + "Paris.")]
    got = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [*((k, k) for k in range(6)), (9, 4), (11, 0)]


def test_words():
    assert decontamination.words_of("L'été, ÉCOLE_2 “quoted”—x y 北京a".encode()) == ["l", "été", "école_2", "quoted", "x", "y", "北", "京", "a"]
    assert decontamination.words_of(None) == decontamination.words_of(" \n…".encode()) == []


def test_ids_of_any_type(spark):
    """Ids of items and documents keep their types."""
    chance = random.Random(3)
    item = " ".join(sentence(chance, 25))
    docs = spark.createDataFrame([("d-1", f"before {item} after"), ("d-2", "w1 w2")], "doc_id string, text string")
    bench = spark.createDataFrame([("q-1", item), (None, "w8 of w9 and w7")], "item_id string, text string")
    got = decontamination.leaks(docs, bench)
    assert dict(got.dtypes)["item_id"] == "string" and [(r.doc_id, r.item_id) for r in got.collect()] == [("d-1", "q-1")]
    assert [r.doc_id for r in decontamination.drop_leaking(docs, bench).collect()] == ["d-2"]


def passages_by_hand(texts, words, idf):
    """Passages of all texts as rows of weights of length 1 over some words."""
    rows = []
    for text in texts:
        for at in range(0, len(ids := text.split()), 32):
            row = np.array([ids[at : at + 32].count(w) for w in words]) * idf
            if row.any():
                rows.append(row / np.sqrt((row**2).sum()))
    return np.array(rows)


def test_pair_sums(spark, monkeypatch):
    """Sums over all passages of more documents than a sample would hold, in one and in several readings, of two spaces that share words."""
    chance = random.Random(41)
    vocab = {f"w{i}": i for i in range(14)}
    texts = [" ".join(f"w{chance.randrange(30)}" for _ in range(chance.choice([1, 31, 32, 33, 200]))) for _ in range(700)]
    weigh = np.array([chance.random() + 0.1 for _ in vocab])
    tile, plots, want = decontamination.TILE, [], []
    for k, chosen in enumerate((list(range(9)), list(range(5, 14)))):
        local = np.full(15, len(chosen), np.int32)
        local[chosen] = np.arange(len(chosen))
        plots.append((k * tile, local, weigh[chosen]))
        a = passages_by_hand(texts, [f"w{i}" for i in chosen], weigh[chosen])
        want.append((a.T @ a)[np.tril_indices(9)])
    docs = spark.createDataFrame([(1, t.encode()) for t in [*texts, ""]] + [(2, None)], "_id int, t binary").repartition(3)
    words, _ = decontamination.numbered(docs, vocab)
    df, n = decontamination.document_frequencies(words, len(vocab))
    assert n == 702 and df.tolist() == [sum(w in t.split() for t in texts) for w in vocab]
    for room in (decontamination.ROOM, tile):
        monkeypatch.setattr(decontamination, "ROOM", room)
        rows = decontamination.pair_sums(words, plots, 2 * tile).collect()
        got = {r["tile"]: np.frombuffer(r["sums"], np.float32) for r in rows}
        assert len(rows) == 2 and all(np.allclose(got[k][:45], want[k], rtol=1e-5) and not got[k][45:].any() for k in (0, 1))
    # readings that cut a space anywhere, and pieces of a text, change nothing
    monkeypatch.setattr(decontamination, "PIECE", 64)
    passages = list(decontamination._passages(words.where("words is not null").select("words").toArrow().to_batches()))
    assert len(passages) > 100
    for lo, hi in ((0, 20), (20, 45), (tile - 5, tile + 31), (10, tile + 45)):
        part = decontamination.PairSums(plots, lo, hi)
        for some in passages:
            part.add(some)
        whole = np.zeros(2 * tile)
        whole[:45], whole[tile : tile + 45] = want
        assert np.allclose(part.sums, whole[lo:hi])


def test_spaces_hold_all_passages(spark):
    """A space is that of the items and of every passage of every document: here the words that tell stand in the 33rd to the 128th place."""
    chance = random.Random(43)
    items = [" ".join(f"w{chance.randrange(40)}" for _ in range(12)) for _ in range(6)]
    words = sorted({w for t in items for w in t.split()})
    texts = []
    for _ in range(600):
        few = chance.sample(words[:12], 4)
        texts.append(" ".join([*["other"] * 32, *chance.choices(few, k=96), *["other"] * 32]))
    ((x,),) = decontamination._passes(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "text", "item_id", "text", 6, 2000, 100_000, 0.5
    )
    (space,) = x.spaces
    idf = np.array([x.weigh[x.vocab[w]] for w in words])
    theirs = passages_by_hand(texts, words, idf)
    a = np.vstack([4 * passages_by_hand(items, words, idf), np.sqrt(min(1, 2000 / len(theirs))) * theirs])
    v = np.array([space.terms[space.local[x.vocab[w]]] for w in words]) / idf[:, None]
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3) and v.shape[1] < len(words)
    best = (np.linalg.svd(a, compute_uv=False)[: v.shape[1]] ** 2).sum()
    assert ((a @ v) ** 2).sum() > 0.99 * best
