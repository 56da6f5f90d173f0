"""Running totals over a folder that only receives new token files.

For append-only feeds of normalised rows. Logs that grow in place need sources.cache: a file stream reads a file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.pricing import total_cost
from tallymill.sources import schemas


def token_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.TOKENS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_totals(tokens: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Turns, tokens and cost by day and tool. Days older than the watermark are closed and leave the state."""
    timed = tokens.withColumn("day", F.to_timestamp("date", "yyyy-MM-dd")).where(F.col("day").isNotNull()).withWatermark("day", lateness)
    return timed.groupBy(F.window("day", "1 day").alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"), total_cost().alias("cost")
    ).select(F.to_date("w.start").alias("day"), "tool", "turns", "total_tokens", "cost")
