"""As-of join: each left row with the latest right row at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.sources.storage import stored


def _both(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_columns: list[str]) -> DataFrame:
    """Rows of both sides on one line: `_k`, `_t`, `_side` (0 right, 1 left) and the row of either side."""
    fields = [F.col(c).alias(c) for c in right_columns]
    found = F.struct(F.col(right_time).alias("_at"), *fields)
    own = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))
    own = own.withColumn("_right", F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType))
    return own.unionByName(right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), found.alias("_right")), allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_columns: list[str]) -> DataFrame:
    """Left rows with the given columns of the match, null without one. One union and one window: no row pairs are formed.

    Right rows at the same time count as earlier; of several at one time the largest by the given columns is taken. All rows of a
    key are sorted in one task; `asof_join_sliced` gives the same rows where a key has too many for that.
    """
    both = _both(left, right, key, left_time, right_time, right_columns)
    upto = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_right")).rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(upto)).where("_side = 1")
    return latest.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in right_columns])


def asof_join_sliced(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_columns: list[str]) -> DataFrame:
    """The same rows as `asof_join`, with no key in one task.

    Both sides are dealt by ranges of key and time, which cuts a large key into time slices, and written. A window runs within a slice; what
    a slice begins with is the last right row of the slices before it, found by a window over one row a slice and key.
    """
    both = _both(left, right, key, left_time, right_time, right_columns)
    # many rows of one key at one time fall into several slices too; right rows come first there
    ordered = both.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("_k", "_t", "_side", "_right", "_row").drop("_row")
    sliced = stored(ordered.withColumn("_slice", F.spark_partition_id()), "asof-slices")
    ends = sliced.groupBy("_k", "_slice").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_right"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_k").alias("_key"), F.col("_slice").alias("_of"), F.last("_end._right", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    upto = Window.partitionBy("_k", "_slice").orderBy("_t", "_side", F.col("_right")).rowsBetween(Window.unboundedPreceding, 0)
    latest = sliced.withColumn("_hit", F.last("_right", ignorenulls=True).over(upto)).where("_side = 1")
    latest = latest.join(carried, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")), "left")
    hit = F.coalesce("_hit", "_carried")
    return latest.withColumn("_hit", hit).select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in right_columns])
