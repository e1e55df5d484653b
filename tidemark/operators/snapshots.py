"""What changed between full snapshots, by gaps and islands.

Each key's rows are numbered along its board's own deliveries. A run of consecutive deliveries
with one row hash is an island, that is a validity interval; the starts, ends and adjacencies of
the intervals are the change events. Two shuffles: one that picks a row per (snapshot, key) with
map-side partial aggregation, one by key for the islands. The list of deliveries is joined salted,
as one board may hold a third of all rows; no window or group is wider than one key.

Defined results
  repeated rows, outdated versions   → the row with the largest ``version`` counts; on a tie the
                                       larger row hash, so that the choice doesn't depend on order
  null version                       → older than any other
  null in a tracked column           → a value
  null key or snapshot number        → the row is left out, it belongs to no job or delivery
  a board's first snapshot           → no events
  empty table                        → no events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import salted_join


def row_hash(columns: list[str]) -> Column:
    """128 bits over the values with nulls told apart from any text."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})))


def validity_intervals(rows: DataFrame, snapshot: str, board: str, key: list[str], tracked: list[str], version: Column) -> tuple[DataFrame, DataFrame]:
    """(intervals, deliveries). intervals: board, key, start, end (positions in the board's deliveries), before, after (ends of the neighbours)."""
    # one row per snapshot and key; only its hash travels
    picked = (
        rows.where(F.col(snapshot).isNotNull() & F.col(board).isNotNull())
        .where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
        .select(F.col(snapshot).alias("_s"), F.col(board).alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(F.coalesce(version, F.lit(-(2**63))).alias("v"), row_hash(tracked).alias("h")).alias("_r"))
    )
    ks = [f"_k{i}" for i in range(len(key))]
    picked = picked.groupBy("_s", "_b", *ks).agg(F.max("_r").alias("_r")).select("_s", "_b", *ks, F.col("_r.h").alias("_h"))
    # deliveries are counted over all rows of the board, also over those with a null key
    seen = rows.where(F.col(snapshot).isNotNull() & F.col(board).isNotNull()).select(F.col(snapshot).alias("_s"), F.col(board).alias("_b")).distinct()
    along = Window.partitionBy("_b").orderBy("_s")
    deliveries = seen.select("_b", "_s", F.row_number().over(along).alias("_n"), F.lead("_s").over(along).alias("_next"))
    numbered = salted_join(picked, deliveries, ["_b", "_s"], F.struct(*ks), how="inner")
    by_key = Window.partitionBy("_b", *ks).orderBy("_n")
    breaks = F.when((F.lag("_n").over(by_key) == F.col("_n") - 1) & (F.lag("_h").over(by_key) == F.col("_h")), 0).otherwise(1)
    islands = numbered.withColumn("_new", breaks).withColumn("_island", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    edge = lambda f: f(F.struct("_n", "_s", "_next"))
    spans = islands.groupBy("_b", *ks, "_island").agg(edge(F.min).alias("first"), edge(F.max).alias("last"))
    by_span = Window.partitionBy("_b", *ks).orderBy("_island")
    return spans.withColumn("before", F.lag("last._n").over(by_span)).withColumn("after", F.lead("first._n").over(by_span)), deliveries


def change_events(rows: DataFrame, snapshot: str, board: str, key: list[str], tracked: list[str], version: Column) -> DataFrame:
    """snapshot, board, key…, change_kind ('added', 'removed', 'changed'); see the module's defined results."""
    spans, _ = validity_intervals(rows, snapshot, board, key, tracked, version)
    start = F.when(F.col("first._n") > 1, F.struct(F.col("first._s").alias("s"), F.when(F.col("before") == F.col("first._n") - 1, "changed").otherwise("added").alias("kind")))
    adjacent = F.coalesce(F.col("after") == F.col("last._n") + 1, F.lit(False))
    end = F.when(F.col("last._next").isNotNull() & ~adjacent, F.struct(F.col("last._next").alias("s"), F.lit("removed").alias("kind")))
    out = spans.select("_b", *[f"_k{i}" for i in range(len(key))], F.explode(F.array_compact(F.array(start, end))).alias("e"))
    return out.select(F.col("e.s").alias(snapshot), F.col("_b").alias(board), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], F.col("e.kind").alias("change_kind"))
