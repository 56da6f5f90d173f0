"""Mergeable summaries of `tokens`: distinct sessions and sizes of turns, of any choice of days and tools, without reading rows.

A summary row holds a HyperLogLog sketch of the sessions and a KLL sketch of the turns' sizes. Both are merged without loss beyond
their own error: the distinct count is off by 1.04 / sqrt(2**LOG_K) (one deviation), a quantile's rank by about 1.7 % at KLL_K = 200.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K, KLL_K = 12, 200
#: One deviation of the distinct count, relative; and the rank error of a quantile that is rarely passed.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_K / 2), 0.0166


def summarized(tokens: DataFrame, by: Sequence[str] = ("tool", "date")) -> DataFrame:
    """One row a group: its keys, turns, total_tokens, and the sketches `sessions` and `sizes`. Groups without a session have an empty sketch."""
    return tokens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("total_tokens").alias("total_tokens"),
        F.hll_sketch_agg("session", F.lit(LOG_K)).alias("sessions"),
        F.kll_sketch_agg_bigint("total_tokens", F.lit(KLL_K)).alias("sizes"),
    )


def merged(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries of larger groups."""
    return summaries.groupBy(*by).agg(
        F.sum("turns").alias("turns"),
        F.sum("total_tokens").alias("total_tokens"),
        F.hll_union_agg("sessions").alias("sessions"),
        F.kll_merge_agg_bigint("sizes").alias("sizes"),
    )


def estimates(summaries: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The sketches read: `sessions` as an estimated number, and a column a quantile (`p50`, `p90`, ...) of the sizes of turns."""
    kept = [c for c in summaries.columns if c not in ("sessions", "sizes")]
    # a sketch of nothing has no quantiles
    some = F.when(F.kll_sketch_get_n_bigint("sizes") > 0, F.col("sizes"))
    read = [F.kll_sketch_get_quantile_bigint(some, F.lit(float(q))).alias(f"p{q * 100:g}") for q in quantiles]
    return summaries.select(*kept, F.hll_sketch_estimate("sessions").alias("sessions"), *read)


def between(summaries: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Summaries of the days from `first` to `last`, compared as text. Undated ones stay, as in filters.since."""
    day, rows = F.col("date"), summaries
    if first is not None:
        rows = rows.where(day.isNull() | (day >= first))
    return rows if last is None else rows.where(day.isNull() | (day <= last))
