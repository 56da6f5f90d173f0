"""Range join: points with the intervals that hold them, as a join on equal keys.

Intervals are filed by length: on level l cells are 2**l units wide, and an interval lies on the first level (every second one is
used) whose cells are at least as wide as it is, so it is filed in two cells at most, however long it is. A point looks into one
cell on each level that has intervals. The exact condition follows the join, and no pair is found twice.

Cells that are crowded are split: their points are dealt into as many slices as keep a slice within `most` rows, their intervals
likewise, and each side is repeated for the slices of the other. So a moment that holds a third of all points comes to many tasks.
The cells that are split come to both sides by broadcast; there are fewer than `most_cells`, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 2


def _position(rows: DataFrame, name: str, unit: float) -> Column:
    """A place on the line in whole units; keeps the order of the values."""
    kind = rows.schema[name].dataType
    if isinstance(kind, T.DateType):
        value = F.unix_date(name).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(F.col(name).cast("timestamp")).cast("double") / 1e6
    else:
        value = F.col(name).cast("double")
    return F.floor(value / F.lit(float(unit))).cast("long")


def _slices(counted: DataFrame, rows: int, most: int, most_cells: int) -> DataFrame:
    return F.greatest(F.ceil(counted / max(most, rows // most_cells + 1)), F.lit(1)).cast("int")


def range_join(
    points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: Sequence[str] = (), unit: float = 1,
    most: int = 100_000, most_cells: int = 100_000,
) -> DataFrame:
    """Rows of `points` with each row of `intervals` that has low <= at <= high and equal `keys`: columns of both, the keys once.

    `at`, `low` and `high` are numbers, dates or timestamps. `unit`: the width of the finest cells (for timestamps in
    seconds, for dates in days). Nulls match nothing; an interval whose end is before its start holds nothing. Other columns of the
    two sides must have different names.
    """
    keys = list(keys)
    holding = intervals.where(F.col(low) <= F.col(high))
    first, last = _position(intervals, low, unit), _position(intervals, high, unit)
    level = (F.ceil(F.log2((F.col("_hi") - F.col("_lo") + 1).cast("double")) / STEP) * STEP).cast("int")
    placed = holding.withColumns({"_lo": first, "_hi": last}).withColumn("_level", level)
    shift = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    # one row a level, so at most 32, whatever the input
    found = placed.groupBy("_level").agg(F.sum(shift("_hi") - shift("_lo") + 1).alias("n")).collect()
    levels, n_intervals = sorted(r["_level"] for r in found), sum(r["n"] for r in found)
    filed = placed.withColumn("_cell", F.explode(F.sequence(shift("_lo"), shift("_hi")))).drop("_lo", "_hi")
    looking = (
        points.where(F.col(at).isNotNull())
        .withColumns({"_at": _position(points, at, unit), "_level": F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))})
        .withColumn("_cell", shift("_at"))
        .drop("_at")
    )
    cell = [*keys, "_level", "_cell"]
    count = lambda rows, name: rows.groupBy(*cell).agg(F.count(F.lit(1)).alias(name))
    n_points = points.count() * len(levels)
    narrow = max(n_points, n_intervals) <= most  # then no cell holds more
    if not narrow:
        crowd = count(looking, "_p").join(count(filed, "_q"), cell)
        crowd = crowd.select(*cell, _slices(F.col("_p"), n_points, most, most_cells).alias("_ps"), _slices(F.col("_q"), n_intervals, most, most_cells).alias("_qs"))
        crowd = F.broadcast(crowd.where("_ps > 1 or _qs > 1"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one slice of its own side, chosen by its place, and in every slice of the other side."""
        if narrow:
            return rows.withColumns({f"{own}_": F.lit(0), f"{other}_": F.lit(0)})
        rows = rows.join(crowd, cell, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_ps", "_qs")})
        rows = rows.withColumn(f"{own}_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int"))
        return rows.withColumn(f"{other}_", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_ps", "_qs")

    pairs = dealt(looking, "_ps", "_qs").join(dealt(filed, "_qs", "_ps"), [*cell, "_ps_", "_qs_"])
    return pairs.where((F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high))).drop("_level", "_cell", "_ps_", "_qs_")
