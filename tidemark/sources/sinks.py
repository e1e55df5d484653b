"""Where results go: parquet replaced as a whole, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table, also one that df reads: its rows are cut to the checkpoint folder first."""
    writer = cut(df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)
