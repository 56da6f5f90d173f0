import random

import pytest

import corpus_pipeline
from tallymill.llm import simhash

SYLLABLES = {"aa": "ka no ri to mé su".split(), "bb": "str ent ung ver ich öt".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(lang, n, chance):
    return " ".join("".join(chance.choices(SYLLABLES[lang], k=chance.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    chance = random.Random(4)
    items = [(i, prose("ab"[i % 2] * 2, 30, chance)) for i in range(10)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    rows = []
    for i in range(300):
        lang = "ab"[i % 2] * 2
        rows.append((i, prose(lang, chance.choice([20, 80]), chance), lang, "s0" if i % 3 else f"s{i % 4}"))
    for i in range(300, 340):
        rows.append((i, rows[i - 300][1], rows[i - 300][2], "s9"))  # exact copies
    for i in range(340, 380):
        words = rows[i - 340][1].split()
        rows.append((i, " ".join([*words[:-1], words[-1] + "ka"]), rows[i - 340][2], None))  # near copies
    for i in range(380, 400):
        rows.append((i, f"{prose('aa', 20, chance)} {items[i % 10][1]} {prose('aa', 20, chance)}", "aa", "s5"))  # leaks
    rows += [(400, None, "aa", "s0"), (401, "", None, None), (402, "%% 12", "bb", "s0"), (403, "xq" * 400, "aa", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(str(place / "documents.parquet"))
    return str(place)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near-dedup", "decontamination", "mixing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, tables)
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            assert set(before) - set(kept[name]) == {400, 401, 402, 403}
        if name == "exact dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert set(kept[name]) == set(last.values())
        if name == "near-dedup":
            prints = {i: simhash.fingerprint(t.encode()) for i, t in before.items()}
            up = {i: i for i in before}

            def top(x):
                while up[x] != x:  # noqa: B023
                    x = up[x]  # noqa: B023
                return x

            for i in before:
                for j in before:
                    if i < j and (prints[i] ^ prints[j]).bit_count() <= 4 and top(i) != top(j):
                        a, b = sorted((top(i), top(j)))
                        up[b] = a
            assert set(kept[name]) == {top(i) for i in before} and len(before) > len(kept[name])
        if name == "decontamination":
            assert set(before) - set(kept[name]) == set(range(380, 400)) & set(before)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    taken = {}
    for r in mixed:
        assert kept["decontamination"][r.doc_id] == r.text and 1 <= r.copy <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size
    for r in mixed:
        assert abs(taken[r.source] - r.target) <= 170
    again = corpus_pipeline.run(spark, tables).collect()
    assert sorted((r.doc_id, r.copy) for r in again) == sorted((r.doc_id, r.copy) for r in mixed)


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_near_copies_go_by_row(spark):
    """Repeated and null ids: one row of each group of near copies stays, and rows that are no copies stay."""
    chance = random.Random(9)
    a, b, c, d = (prose("aa", 60, chance) for _ in range(4))
    texts = [(5, b), (5, a), (3, a.replace(" ", "  ")), (7, c), (7, c.replace(" ", "  ")), (None, d), (None, d.replace(" ", "  ")), (None, None)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in texts], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(got) == 5 and {(5, b), (3, a.replace(" ", "  ")), (None, None)} < set(got)
    assert sum(t in (c, c.replace(" ", "  ")) for _, t in got) == 1 and sum(t in (d, d.replace(" ", "  ")) for _, t in got) == 1


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    """Columns named like the operators' own, repeated and null ids, and a very long text go through all stages; clean rows stay."""
    chance = random.Random(21)
    items = [(i, prose("aa", 30, chance)) for i in range(4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [prose("ab"[i % 2] * 2, chance.choice([30, 60, 120]), chance) for i in range(160)] + [prose("aa", 40_000, chance)]
    rows = [(None if i % 20 == 7 else i // 4, t, "ab"[i % 2] * 2 if i < 160 else "aa", "s", 5, "k", "x", True) for i, t in enumerate(texts)]
    rows += [rows[3], (900, f"{texts[0]} {items[1][1]}", "aa", "s", 5, "k", "x", False), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, size long, _id string, component_id string, kept boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.text for r in got}
    assert kept == set(texts), (len(kept), len(texts))
    assert {(r.doc_id, r.text, r.kept) for r in got} == {(i, t, k) for i, t, *_, k in rows if t in kept}
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "_id", "component_id", "kept", "size", "source_size", "target", "copy"]


def test_any_other_columns(spark, tmp_path):
    """Columns of any name and type go through all stages unchanged."""
    chance = random.Random(33)
    items = [(f"q-{i}", prose("aa", 30, chance)) for i in range(4)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = chance.sample("_of _id _digest row row_id row_digest id digest key last _key _rest _null _row _text _salt label node a b u v m n _fp _n _n_words _block _item item_id rank leaked".split(), 14)
    kinds = ["cast(doc_id as int)", "map('k', doc_id)", "array(doc_id)", "struct(doc_id as x, text as y)", "cast(text as binary)", "doc_id % 2 = 0", "cast(doc_id as decimal(9,2))"]
    texts = [prose("ab"[i % 2] * 2, chance.choice([30, 60, 120]), chance) for i in range(120)] + [f"{prose('aa', 20, chance)} {items[0][1]}"]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2] * 2 if i < 120 else "aa", "s", 5) for i, t in enumerate(texts)], SCHEMA)
    docs = docs.selectExpr("*", *[f"{kinds[i % len(kinds)]} AS `{n}`" for i, n in enumerate(names)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [f.dataType for f in got.schema.fields if f.name in names] == [f.dataType for f in docs.schema.fields if f.name in names]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(range(120)) and all(r[c] == before[r.doc_id][c] for r in rows for c in ["text", "lang", *names])
