"""Recorded responses joined to requests: what a fetch of each URL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def respond(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """requests (url, etag) with ``outcome``: 'body', 'not_modified', 'not_found' or 'failed', and the response's path and body.

    A URL without a route is not found; a matching ETag is not modified.
    """
    r = routes.select("url", "status", "path", "body", F.col("etag").alias("now_etag"))
    outcome = (
        F.when(F.col("status").isNull() | (F.col("status") == 404), "not_found").when(F.col("status") >= 400, "failed")
        .when((F.col("status") == 304) | (F.col("etag") == F.col("now_etag")), "not_modified").otherwise("body")
    )
    got = requests.join(r, "url", "left").withColumn("outcome", outcome)
    keep = F.col("outcome") == "body"
    return got.select(*requests.columns, "outcome", F.when(keep, F.col("path")).alias("path"), F.when(keep, F.col("body")).alias("body"), "now_etag")


def unprocessed(items: DataFrame, processed: DataFrame, key: list[str]) -> DataFrame:
    """Items of append-only sources that no earlier run has handled."""
    return items.join(processed.select(*key).distinct(), key, "left_anti")


def lowest_ids(jobs: DataFrame, job_id: str, n: int) -> DataFrame:
    """The n smallest distinct numeric ids: a sampling operator, the limit is its feature."""
    return jobs.select(F.col(job_id).try_cast("bigint").alias(job_id)).where(f"{job_id} IS NOT NULL").distinct().orderBy(job_id).limit(n)
