import random
import re

from tallymill.llm import mixing


def targets(sizes, weights=3, at_most=3):
    """Shares the sum by weight; what is above a limit is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % weights + 1 for i, s in enumerate(names)}
    got, spare, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while spare > 1e-6 and open_:
        share = spare / sum(weight[s] for s in open_)
        spare = 0.0
        for s in list(open_):
            got[s] += share * weight[s]
            if got[s] >= at_most * sizes[s]:
                spare += got[s] - at_most * sizes[s]
                got[s] = float(at_most * sizes[s])
                open_.discard(s)
    return got


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix(spark):
    chance = random.Random(3)
    rows = [(i, " \t\n".join(["wörd\u00a0x"] * chance.choice([0, 1, 5, 20, 300])), chance.choice(["a", "b", "b", "b", "b", "ä", None]), "clash") for i in range(2000)]
    rows += [(5000, "one two", "tiny", None), (5001, None, "none", None), (5002, "", "none", None), (5003, "x", "", None)]
    got = mixing.mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * 300 + 2, s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(_docs(spark, rows).repartition(7)).collect()), key=str)


def test_mixed_rows(spark):
    rows = [(i, "a b c", "s" if i % 3 else "t", None) for i in range(90)] + [(1, "a b c", "s", None)]
    docs = _docs(spark, rows)
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copy"]
    drawn = {r.doc_id: 0 for r in docs.collect()}
    for r in got.collect():
        drawn[r.doc_id] += 1
    assert max(drawn.values()) <= 6 and abs(sum(drawn.values()) - 91) <= 3
    assert mixing.mixed(docs.where("false").drop("size")).count() == 0 and mixing.mix(docs.where("text is null")).count() == 0


def test_size_of_nothing(spark):
    got = mixing.mix(_docs(spark, [(1, None, "a", None), (2, " ", None, None)])).collect()
    assert [(r.size, r.copies, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_ties_agree_between_runs(spark):
    """Rows of one id and size but different texts: the same ones are drawn however the rows are dealt."""
    rows = [(k // 4, f"word{k % 4} b c", "s" if k % 5 else "t", k) for k in range(400)] + [(None, None, None, 1), (7, "x " * 200_000, "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    first = sorted(map(str, mixing.mixed(docs.repartition(1)).collect()))
    assert first == sorted(map(str, mixing.mixed(docs.repartition(7, "text")).collect()))
    plain = lambda df: sorted(map(str, mixing.mix(df).collect()))
    assert plain(docs.repartition(1)) == plain(docs.repartition(7, "text"))


def test_rows_with_maps(spark):
    """Rows of any type are carried along, maps and what holds them included; rows that differ in them alone are told apart."""
    docs = spark.range(60).selectExpr("id % 20 AS doc_id", "concat('w ', 'w ', id) AS text", "'s' AS source")
    docs = docs.selectExpr("*", "map('k', text) AS size_map", "array(struct(map(1, text) AS m)) AS deep", "cast(text AS binary) AS raw", "parse_json('[1]') AS free")
    first = sorted((r.doc_id, r.text, r.copy, r.size_map["k"], r.deep[0].m[1]) for r in mixing.mixed(docs).collect())
    again = sorted((r.doc_id, r.text, r.copy, r.size_map["k"], r.deep[0].m[1]) for r in mixing.mixed(docs.repartition(3)).collect())
    assert first == again and all(t == m == d for _, t, _, m, d in first) and first
