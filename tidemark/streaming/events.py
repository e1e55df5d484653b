"""The batch operators that make sense on a stream: de-duplication by id and windowed counts.

Both keep state only within the watermark, so it doesn't grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once; repeats that come later than ``late`` after the watermark may come again."""
    return stream.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def counts(stream: DataFrame, at: str, late: str, every: str, by: list[str]) -> DataFrame:
    """window_start, by…, n per tumbling window; rows later than ``late`` are left out, as the watermark says."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "n")
