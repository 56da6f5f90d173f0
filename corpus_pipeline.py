"""A training corpus in five stages, each over all that the one before kept.

    language ID -> exact dedup -> near-dedup -> benchmark decontamination -> mixing

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs no more than the stage
that runs; what a stage wrote besides is deleted after it. Each stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last returns one row per copy
of a document in the mix, with the columns `size`, `source_size`, `target` and `copy` besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import decontamination, exact_dedup, language_id, mixing, simhash
from tallymill.llm.common import fold, remove, scratch_scope, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that fit none of the languages; learns from labelled rows that are not held out."""
    models = language_id.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    return language_id.keep_accepted(docs, models)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the row with the smallest doc_id stays, of equal ids the one whose text has the smallest digest.

    Null ids come last. Rows are told apart by id and text, which the exact dedup before leaves different in each.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), digest.alias("digest"))
    marked = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    dropped = marked.where(~F.col("component_id").eqNullSafe(F.col("key"))).select("key.id", "key.digest")
    # whole rows travel in one column, so that none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"), digest.alias("row_digest"))
    left = rows.join(dropped, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item leaked into."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights; one row per copy."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The first, third and fourth stage have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as keep:
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            keep(path)
        if before:
            remove(spark, before)
        before = path
    return docs
