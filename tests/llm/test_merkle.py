import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallymill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of nodes from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i - i % 16
        out.append((i % 16, [x for j, x in enumerate(nodes[start : start + 16], start) if j != i]))
        i //= 16
    return out


def plain(rows):
    """Sorted rows (doc_id, leaf, subroot, root, proof) from the definitions."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    listed = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r), r[0]) for r in rows if r[1] == s)) for s in sources}
    trees = {s: tree([x[2] for x in listed[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, x in enumerate(listed[s]):
            siblings = [h for _, run in path(trees[s], i) + path(top, k) for h in run]
            out.append((x[3], x[2], trees[s][-1][0], top[-1][0], sha("".join(siblings))))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 700, 4096])
def test_paths_of_a_block(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.levels_of(n) == len(levels) - 1 and merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
    got = [[(at, run[:at] + run[at + 1 :]) for at, run in found] for found in merkle.paths(leaves, len(levels) - 1)]
    assert got == [path(levels, i) for i in range(n)]
    assert {merkle.folded(x, [(at, "".join(s)) for at, s in p]) for x, p in zip(leaves, got, strict=True)} == {levels[-1][0]}


def test_a_run_holds_few_digests():
    """Growing a run of the third level keeps at most 16 digests on each level."""
    grown = merkle.Subtree(2)
    for i in range(4096):
        grown.feed(str(i))
        assert all(len(run) <= merkle.WIDTH for run in grown.open)
    assert len(grown.closed()) == 16


@pytest.fixture
def rows():
    chance = random.Random(3)
    made = [(i, f"s{i % 3}" if i % 5 else None, None if i % 7 == 0 else "en", i, chance.choice(["", None, "Ähm x", "A" * 50])) for i in range(200)]
    made += [(None, "s1", "en", 1, "no id"), (None, "s1", "en", None, "no id"), (7, "s1", "en", 7, "again"), (7, "s1", "en", 7, "again"), (5000, "", "de", 4, "empty name"), (5001, "alone", "de", 4, "L" * 300_000)]
    return made + [(i, "big", "en", 0, None) for i in range(10_000, 18_500)]


def test_manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == plain(rows)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_tampered_rows_do_not_verify(spark, rows):
    rows = rows[:206]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{SCHEMA}, leaf string, _digest string").repartition(3)
    changed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    got = merkle.manifest(docs, claimed=[changed if c == "text" else F.col(c) for c in merkle.FIELDS]).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == plain(rows)
    texts = {r[0]: r[4] for r in rows}
    for r in got:
        assert r.verified == (r.folded_root == r.root) == (r.doc_id is None or r.doc_id % 2 == 1 or texts[r.doc_id] is None)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    (one,) = merkle.manifest(docs).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified
    assert merkle.manifest(docs.where("false")).count() == 0
