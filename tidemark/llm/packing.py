"""Texts → containers of fixed capacity, by sum-of-squares packing.

Sizes are tokens of a public tokenizer. A text larger than a container gives full containers of its
own and one rest; nothing else is split. Each group of items, spread by hash so that no group grows
beyond ``GROUP`` items, is packed on its own: an item goes where the sum of the squared numbers of
open containers per remaining gap becomes smallest, larger items first. A group leaves a few
half-empty containers; these are opened again and their items packed in the next round, in fewer
groups, until one group holds them all or a round settles none. No group of unbounded size reaches a
task, only the number of items left reaches the driver.

Defined results
  null text                     → no item
  empty text                    → size 0, put with the others
  equal sizes, repeated rows    → each row is an item; ties by id and then by row order
  extra columns                 → ignored
  empty table                   → no containers
  text above the capacity       → pieces of exactly the capacity, each alone, and one smaller rest
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

#: Items in a group at most, about; containers with a larger gap than this share are packed again.
GROUP, LOOSE = 100_000, 1 / 256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level BPE vocabularies split a text into words.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    """bigint: tokens of the whole text; null for null. The vocabulary file at path goes to every executor."""
    SparkSession.active().sparkContext.addFile(path)
    name = Path(path).name

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([None if t is None else len(encoder.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items taken in the order given; sizes are at most capacity."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # containers per gap; full ones don't count
    members: dict[int, list[int]] = defaultdict(list)
    placed, made = np.empty(len(sizes), dtype=np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            placed[i] = max(made - 1, 0)
            made = max(made, 1)
            continue
        # an old container with gap g turns into one with gap g - size
        change = 2 * (open_at[: capacity + 1 - size] - open_at[size:]) + 2
        change[0] -= 2 * open_at[0] + 1
        change[open_at[size:] == 0] = np.iinfo(np.int64).max
        rest = capacity - size
        fresh = 2 * open_at[rest] + 1 if rest else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= fresh:
            gap = best + size
            container = members[gap].pop()
            open_at[gap] -= 1
            rest = best
        else:
            container, made = made, made + 1
        if rest:
            open_at[rest] += 1
            members[rest].append(container)
        placed[i] = container
    return placed


def _pack_group(capacity: int, number: int, loose: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True], kind="stable")
        sizes = rows["n_tokens"].to_numpy(dtype=np.int64)
        where = sum_of_squares(sizes, capacity)
        filled = np.bincount(where, weights=sizes, minlength=1)
        rows["container"] = [f"{number}-{g}-{w}" for g, w in zip(rows["grp"], where)]
        rows["settled"] = (capacity - filled[where]) <= loose
        return rows

    return pack


def pack(items: DataFrame, item_id: str, size: str, capacity: int, group: int = GROUP) -> DataFrame:
    """item, piece, n_tokens, container for every row of items; see the module's defined results."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{size}`").cast("bigint").alias("size")).where("size IS NOT NULL AND size >= 0")
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = (F.col("size") % capacity).cast("bigint")
    full = F.transform(F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>")), lambda k: F.struct((k - 1).alias("piece"), F.lit(capacity).cast("bigint").alias("n")))
    last = F.when((rest > 0) | (whole == 0), F.array(F.struct(whole.alias("piece"), rest.alias("n")))).otherwise(F.array().cast("array<struct<piece:int,n:bigint>>"))
    pieces = cut(rows.select("item", F.explode(F.concat(full, last)).alias("p")).select("item", "p.piece", F.col("p.n").alias("n_tokens")))
    # pieces that fill a container alone need no packing
    done = [pieces.where(F.col("n_tokens") == capacity).select("item", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), "piece").alias("container"))]
    left = pieces.where(F.col("n_tokens") < capacity)
    number, loose, before = 0, int(capacity * LOOSE), None
    while True:
        count = left.count()
        groups = -(-count // group)
        spread = left.select("item", "piece", "n_tokens", F.pmod(F.xxhash64("item", "piece", F.lit(number)), F.lit(max(groups, 1))).alias("grp"))
        # items that no round settles stay where they are; as they were spread anew, more rounds would hardly help
        final, before = groups <= 1 or count == before, count
        packed = cut(spread.groupBy("grp").applyInPandas(_pack_group(capacity, number, capacity if final else loose), spread.schema.simpleString()[7:-1].replace(":", " ") + ", container string, settled boolean"))
        done.append(packed.where("settled").select("item", "piece", "n_tokens", "container"))
        if final:
            break
        left, number = packed.where("NOT settled").select("item", "piece", "n_tokens"), number + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
