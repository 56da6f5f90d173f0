"""Exact deduplication by skew-safe combining.

Equal texts are combined three times, each time by comparing the full content (the text itself is a grouping key,
its SHA-256 only spreads the rows): within each input partition (partial aggregation), then within each of `salts` slices
of the input partitions, and across the slices. A group of copies that holds a third of all rows leaves one row in each
partition, so neither of the two later steps gets more rows of it than partitions by `salts`, or `salts`. On the way back
to the rows, groups of very many rows are broadcast, a proven number at most, and their rows are dealt by place, so it does not
matter how many share an id or have none; the others are joined by digest. Only
built-in functions are used.

Defined results: a null text counts as empty; of equal texts the largest id stays; null ids come last; a row that
repeats id and text of another is a copy of it, and exactly one of the two is kept; an empty table gives an empty
result; very long texts are compared whole; other columns are ignored by `exact_dedup` and carried along by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import with_groups, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _slice(salts: int) -> Column:
    """A slice of the input partitions: copies that one partition holds share it."""
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 1024, digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the text; `digest` only spreads rows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_digest", digest(F.col("_text")))
    sliced = rows.withColumn("_salt", _slice(salts)).groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    classes = (
        sliced.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .withColumn("_texts", F.count(F.lit(1)).over(Window.partitionBy("_digest")))
        .where((F.col("_n") > 1) | (F.col("_texts") > 1))
        .withColumn("_text", F.when(F.col("_texts") > 1, F.col("_text")))
    )
    classes, _ = written(classes, "dedup-classes")
    plain = classes.where("_texts = 1").select("_digest", "_keep", "_n")
    # the written class table cannot grow once read, so this is one count over a narrow table
    clashing = classes.where("_texts > 1").select("_digest", "_text", F.struct("_keep", "_n").alias("_group"))
    if clashing.isEmpty():
        narrow = rows.select("_id", "_digest", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"))
        joined = with_groups(narrow, plain, ["_digest"], "_n", F.monotonically_increasing_id())
    else:  # different texts with one digest: their rows are matched by the text itself
        narrow = rows.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))
        hit = clashing.select("_digest").distinct().withColumn("_hit", F.lit(True))
        narrow = narrow.join(hit, "_digest", "left")
        one = with_groups(narrow.where("_hit is null").drop("_hit", "_text"), plain, ["_digest"], "_n", F.monotonically_increasing_id())
        two = narrow.where("_hit").drop("_hit").join(clashing, ["_digest", "_text"]).drop("_text").withColumn("_spread", F.lit(0).cast("long"))
        joined = one.unionByName(two)
    keep = F.when(F.col("_group").isNull(), F.col("_id")).otherwise(F.col("_group._keep"))
    told = joined.select("_id", "_sha", keep.alias("_keep"), F.coalesce("_group._n", F.lit(1)).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row"))
    told, _ = written(told, "dedup-rows")
    # which of the rows that repeat an id and a text stays is arbitrary: they differ in nothing that counts. One of them is named, by
    # partial sums, where there is more than one
    won = F.col("_id").eqNullSafe(F.col("_keep"))
    again = told.where(won & (F.col("_n") > 1)).groupBy("_sha").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    again, _ = written(again, "dedup-repeated")
    kept = won
    if not again.isEmpty():
        told = with_groups(told, again, ["_sha"], "_rows", F.col("_row"))
        kept = won & (F.coalesce(F.col("_group._first"), F.col("_row")) == F.col("_row"))
    return told.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        kept.alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 1024) -> DataFrame:
    """The rows that stay, with all their columns: the same combining, the whole row travelling with its text."""
    columns = docs.columns
    rest = [F.col(f"`{c}`") for c in columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        text.alias("_text"),
        F.struct(F.col(id_col).alias("_key"), F.struct(*rest).alias("_rest"), F.col(text_col).isNull().alias("_null")).alias("_row"),
    ).withColumns({"_digest": sha256(F.col("_text")), "_salt": _slice(salts)})
    best = F.max_by("_row", F.struct("_row._key")).alias("_row")
    sliced = rows.groupBy("_digest", "_salt", "_text").agg(best)
    won = sliced.repartition("_digest").groupBy("_digest", "_text").agg(best)
    return won.select(
        *[
            F.when(~F.col("_row._null"), F.col("_text")).alias(c) if c == text_col else F.col("_row._rest").getField(c).alias(c)
            for c in columns
        ]
    )
