"""Helpers that the training-data operators share: table reading, the shared folder, text units."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.sources.storage import Files, shared_dir

#: A word: a maximal run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of a key written as text (null: empty), modulo `modulus`: the hold-out rule of the queries."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def with_groups(
    rows: DataFrame, groups: DataFrame, key: list[str], size: str, spread: Column, total: int | None = None, hot_rows: int = 100_000, most_hot: int = 100_000, hint: str | None = None,
    own: dict[str, Column] | None = None,
) -> DataFrame:
    """Left join of rows with groups, one row a key, whose column `size` tells how many rows the key has: adds `_group`, a struct of
    the group's columns, and `_spread`, 0 or a hash of `spread`.

    No key brings more rows to a task than `hot_rows` or, if more, the `most_hot`th part of all rows: larger groups come to
    their rows by broadcast, and the rows are dealt on by `_spread` too. So fewer than `most_hot` groups are broadcast,
    whatever the input. `total`: the sum of the sizes, counted here where it is not known. `hint`: how the other groups are joined.
    `own`: aggregates of the rows that the groups stand for, where these are of all the rows of a key and no others; then rows that are
    together no more than `hot_rows` get them by a window, one exchange instead of three and a broadcast.
    """
    values = F.struct(*[F.col(c) for c in groups.columns if c not in key])
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    if own and total <= hot_rows:
        found = F.struct(*[c.over(Window.partitionBy(*key)).alias(name) for name, c in own.items()])
        return rows.withColumn("_spread", F.lit(0).cast("long")).withColumn("_group", found)
    limit = max(hot_rows, total // most_hot + 1)
    hot = groups.where(F.col(size) > limit).select(*key, values.alias("_hot"))
    rest = groups.where(F.col(size) <= limit).select(*key, F.lit(0).cast("long").alias("_spread"), values.alias("_rest"))
    rest = rest.hint(hint) if hint else rest
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread)))
    return dealt.join(rest, [*key, "_spread"], "left").withColumn("_group", F.coalesce("_hot", "_rest")).drop("_hot", "_rest")


def ranked(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Adds `_pos`, a row's place (from 0) among the rows of its key in the given order, and `_of`, how many rows the key has.

    No key comes to one task, however many of the rows it has: the rows are dealt by ranges of key and order and written, the
    ranges are counted by key, and only places within one range are counted by a window. Key columns must not be null; rows
    that are equal in `order` must be free to stand in any order. What else is broken up runs over one row a range and key.
    """
    spread = F.monotonically_increasing_id()  # equal rows fall into different ranges too
    ordered, _ = written(
        rows.withColumn("_spread", spread).repartitionByRange(*key, *order, "_spread").withColumn("_range", F.spark_partition_id()), "ranges"
    )
    in_range = Window.partitionBy("_range", *key)
    ranges = ordered.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "_range", *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), F.sum("_n").over(Window.partitionBy(*key)).alias("_of")
    )
    placed = ordered.withColumn("_in", F.row_number().over(in_range.orderBy(*order, "_spread")) - 1).join(ranges, ["_range", *key])
    return placed.withColumn("_pos", F.col("_in") + F.col("_skip")).drop("_range", "_spread", "_in", "_skip")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `scratch` named."""
    if path in _made:
        _made.remove(path)
    Files(spark).delete(path)


#: Folders that are there until the program ends or `scratch_scope` does.
_made: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes what operators wrote to the shared folder inside it, once their result has been written: `with scratch_scope(spark) as
    keep: ...`; a path given to `keep` stays."""
    before, kept = len(_made), []
    yield kept.append
    for path in [p for p in _made[before:] if p not in kept]:
        remove(spark, path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if urlparse(path).scheme in ("", "file"):
        shutil.rmtree(mounted(path), ignore_errors=True)
        return
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone by now; then the folder stays
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the program ends or a `scratch_scope` around it does."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(_remove_at_exit, spark, path)
    return path


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors. Returns it and its path."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def mounted(path: str) -> str:
    """The local name of a shared folder, for files that tasks map into memory. It must be mounted on every machine (file: scheme)."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder (file:), spark.checkpoint.dir is {path}")
    return unquote(parts.path) if parts.scheme else path


def publish(path: str, payload: bytes) -> None:
    """Writes a file of a shared folder in one step, so that a repeated task attempt leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(payload)
    os.replace(part, path)
