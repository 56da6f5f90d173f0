"""Audit of how five text filters interact: what each removes at each place of every order in which they may run.

Filters, by the letter of what fails: A under 200 words; B fewer than half as many distinct words as words; C over 2 % capitals
A-Z among the code points; D a character of `#$%&*|`; E a text identical to that of a smaller id.

E is found by partition refinement. Rows are split by code-point length, then by the hash of their first block, of the next one
and so on (blocks end at `ENDS` code points, the last one takes the rest); after each split, rows that are alone in their
class are dropped. The full texts of the rows that are left are compared: they are the grouping key, first within each of
`salts` slices of the input partitions, then across slices, so no class brings many equal texts to one task. In each class
the rows of other than the smallest id are marked. Then rows are counted by part and by the mask of filters they fail, and
all orders are answered from these 32 counts a part: rows are read no more often for 120 orders than for one.

Texts are read twice, once for the signature (length, block hashes, mask) and once for the comparison; what is written
and refined is a narrow row each.

Defined results: a null text counts as empty; a null part counts as the empty string; a null id is neither smaller nor larger
than another, so it fails nothing and makes nothing fail; rows that share the smallest id of their text all pass; labels that
repeat an id count once (any mark counts), ids without a label have no mark; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import WORD, with_groups, written

LETTERS = "ABCDE"
#: Last code points of the blocks that are hashed one after the other.
ENDS = (64, 1024, 16384)
HASHES = [f"_h{i}" for i in range(len(ENDS) + 1)]


def block_hash(text: Column, block: int) -> Column:
    """64-bit hash of a block of a text; that of an empty string where the text has ended."""
    start = ENDS[block - 1] if block else 0
    return F.xxhash64(F.substring(text, start + 1, ENDS[block] - start if block < len(ENDS) else 2**31 - 1 - start))


def mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits in that order."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < 200,
        100 * distinct < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        F.rlike(text, F.lit("[#$%&*|]")),
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def refine(rows: DataFrame) -> DataFrame:
    """The rows whose class by length and all block hashes holds others too. Each split is counted with partial sums and comes back to
    the rows with classes of very many rows broadcast, a bounded number."""
    key = ["_len"]
    for h in [None, *HASHES]:
        key = key if h is None else [*key, h]
        classes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        kept = with_groups(rows, classes, key, "_n", F.monotonically_increasing_id()).where(F.col("_group").isNotNull())
        rows, _ = written(kept.select(*rows.columns), "refined")
    return rows


def mark_copies(
    docs: DataFrame, more: dict[str, Column], of_text: dict[str, Callable[[Column], Column]], id_col: str = "doc_id", text_col: str = "text", salts: int = 1024
) -> DataFrame:
    """One row per input row: `_id`, columns of the input by the names in `more`, what the functions of `of_text` make of the text (null as
    empty), and `copy`, whether a smaller id has the same text."""
    key, told = ["_len", *HASHES], ["_id", *more, *of_text]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *[c.alias(name) for name, c in more.items()])
    rows = rows.select("_id", "_text", *more, *[f(F.col("_text")).alias(name) for name, f in of_text.items()], F.length("_text").alias("_len"), *[block_hash(F.col("_text"), i).alias(h) for i, h in enumerate(HASHES)])
    signed, _ = written(rows.drop("_text"), "signatures")
    classes, _ = written(refine(signed.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "refined-classes")
    spread = F.monotonically_increasing_id()
    # the classes are narrow and one row each, so texts are dealt once and not sorted
    left = with_groups(rows.select("_id", "_text", *key), classes, key, "_n", spread, hint="shuffle_hash").where(F.col("_group").isNotNull())
    sliced = left.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*key, "_slice", "_text").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    texts = sliced.repartition(*key).groupBy(*key, "_text").agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"))
    texts = texts.withColumn("_texts", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n > 1 or _texts > 1")
    texts, _ = written(texts.withColumn("_text", F.when(F.col("_texts") > 1, F.col("_text"))), "refined-texts")
    copy = lambda least: F.coalesce(F.col("_id") > F.col(least), F.lit(False)).alias("copy")
    plain, clashing = texts.where("_texts = 1").select(*key, "_n", "_least"), texts.where("_texts > 1").select(*key, "_text", "_least")
    if clashing.isEmpty():
        return with_groups(signed, plain, key, "_n", spread).select(*told, copy("_group._least"))
    # different texts with equal lengths and hashes: their rows are told apart by the text itself
    hit = clashing.select(*key).distinct()
    one = with_groups(signed.join(hit, key, "left_anti"), plain, key, "_n", spread).select(*told, copy("_group._least"))
    return one.unionByName(rows.join(hit, key).join(clashing, [*key, "_text"]).select(*told, copy("_least")))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", salts: int = 1024
) -> DataFrame:
    """One row per part, order of the filters and step in it: documents kept after the step, removed by it, redundant (they fail its filter
    but went before), unique_fails (they fail its filter alone), removed documents of good quality and toxic ones, and the
    filter's removals over all orders."""
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    marked = mark_copies(docs, {"part": part}, {"_mask": mask}, id_col, text_col, salts)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic")
    )
    failed = F.col("_mask") + F.when(F.col("copy"), 16).otherwise(0)
    counted = marked.join(told, "_id", "left").groupBy("part", failed.alias("_failed")).agg(
        F.count(F.lit(1)).alias("_all"), F.sum(F.coalesce("_good", F.lit(0))).alias("_good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("_toxic")
    )
    return orders(counted)


def orders(counted: DataFrame) -> DataFrame:
    """The audit's rows from counts by part and mask of failed filters: columns part, _failed, _all, _good, _toxic."""
    names = ("_all", "_good", "_toxic")
    by_mask = [F.array(*[F.coalesce(F.sum(F.when(F.col("_failed") == m, F.col(c))), F.lit(0)) for m in range(1 << len(LETTERS))]).alias(c) for c in names]
    told = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])).alias("filter_order")
    steps = counted.groupBy("part").agg(*by_mask).select("*", told).select("*", F.explode(F.array(*[F.lit(i) for i in range(1, len(LETTERS) + 1)])).alias("step"))
    before, own = F.substring("filter_order", F.lit(1), F.col("step") - 1), F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumns({"_before": bits(before), "_bit": bits(own)})

    def where(counts: str, holds) -> Column:
        """Sum of the counts of the masks for which `holds(mask)`."""
        picked = F.transform(counts, lambda n, m: F.when(holds(m), n).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, n: a + n)

    gone, fails = lambda m: m.bitwiseAND(F.col("_before")) != 0, lambda m: m.bitwiseAND(F.col("_bit")) != 0
    here = lambda m: fails(m) & ~gone(m)
    answered = steps.withColumns(
        {
            "kept": where("_all", lambda m: ~gone(m) & ~fails(m)),
            "removed": where("_all", here),
            "redundant": where("_all", lambda m: fails(m) & gone(m)),
            "unique_fails": where("_all", lambda m: m == F.col("_bit")),
            "good_lost": where("_good", here),
            "toxic_lost": where("_toxic", here),
        }
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "_bit")).alias("shapley")
    return answered.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
