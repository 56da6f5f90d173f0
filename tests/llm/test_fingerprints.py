import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tallymill.llm import fingerprints

PIECES = re.compile(fingerprints.PIECE)
TEXTS = [
    "One sentence here. Another one! And a third?\nA new line. One sentence here.", "", None, "  \n\t ", "word", "no end " * 200, "x" * 200_000, "é ü 漢字. 漢字 é.\nü", "a.b.c d.e\n\nf", "Same text.", "Same text.",
    "Line one of it.\nLine two of it.\nLine three.", "Line two of it.\nLine three.\nLine one of it.", "long " * 60_000,
]


def lanes(text):
    total = [0] * 137
    for piece in PIECES.findall(text or ""):
        digest = hashlib.sha256(piece.encode()).hexdigest()
        words = [int(digest[8 * i : 8 * i + 8], 16) for i in range(8)]
        bits = [words[2 * half + side] >> j & 1 for half in range(2) for j in range(32) for side in range(2)]
        total = [(a + b) % 2**32 for a, b in zip(total, [1, *words, *bits], strict=True)]
    return total


def like(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - v[0] for c in v[9:]] for v in (a, b))
    norm = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm)) if norm else 0.0


def plain(rows):
    """Sorted by id (null last) and by `order` of the text; ties must be equal rows."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        own, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = lanes(own), lanes(edited), lanes(after)
        hexed = lambda v: "".join(f"{x:08x}" for x in v)
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_neighbours(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _row string, lanes long").repartition(5).write.parquet(str(tmp_path / "docs"))
    assert told(fingerprints.neighbours(spark.read.parquet(str(tmp_path / "docs")))) == plain(rows)


def test_repeated_and_missing_ids(spark):
    """Equal rows stand in any order; null ids come last."""
    rows = [(1, "Twice the same. Yes."), (1, "Twice the same. Yes."), (2, "Other text. No."), (None, "Without an id. At all."), (None, "Without an id. At all.")]
    assert told(fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == plain(rows)


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "Only one. Here.")], "doc_id long, text string")
    assert told(fingerprints.neighbours(one)) == plain([(5, "Only one. Here.")])
    assert fingerprints.neighbours(one.where("false")).count() == 0


@pytest.fixture(scope="module")
def prints(spark):
    texts = {0: "Alpha one. Beta two.", 1: "Beta two. Gamma three.", 2: "Beta two. Alpha one.", 3: "Alpha one. Beta two. Beta two. Gamma three.", 4: "Alpha one."}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string")
    return {r.k: r.lanes for r in fingerprints.fingerprinted(rows, ["k"], "t").collect()}


def test_sums_of_pieces(spark, prints):
    """Order does not count; pieces are added and deleted by adding and subtracting."""
    assert prints[0] == prints[2] != prints[1] and all(len(v) == 137 for v in prints.values())
    frame = spark.createDataFrame([(prints[0], prints[1], prints[3])], "a array<long>, b array<long>, c array<long>")
    got = frame.select(fingerprints.added(F.col("a"), F.col("b")).alias("s"), fingerprints.removed(F.col("c"), F.col("b")).alias("d")).first()
    assert got.s == prints[3] and got.d == prints[0]


def test_likeness(spark, prints):
    pairs = spark.createDataFrame([(prints[0], prints[0]), (prints[0], prints[1]), (prints[4], prints[1])], "a array<long>, b array<long>")
    same, half, none = (r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect())
    assert same == 1.0 and abs(half - 0.5) < 0.3 and none < 0.3


def test_counts_wrap(spark):
    """Numbers are kept modulo 2**32, so a deletion from less than there is can be undone."""
    top = [2**32 - 1] * 137
    frame = spark.createDataFrame([(top, [2] * 137)], "a array<long>, b array<long>")
    got = frame.select(fingerprints.added(F.col("a"), F.col("b")).alias("s"), fingerprints.removed(F.col("b"), F.col("a")).alias("d")).first()
    assert set(got.s) == {1} and set(got.d) == {3}


def test_no_python_in_the_plan(spark, tmp_path):
    """The whole operator is built of Spark's own functions, and the texts are dealt by row once: the second use reads the same exchange."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    rows = fingerprints.fingerprinted(spark.read.parquet(str(tmp_path / "docs")), ["doc_id"], "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "HashAggregate" in plan and "SortAggregate" not in plan
