import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.packing import TOKENIZER, pack, sum_of_squares, token_counts


def squares(levels, capacity):
    """Sum of the squared numbers of open containers per gap."""
    open_ = [f for f in levels if f < capacity]
    return sum(open_.count(f) ** 2 for f in set(open_))


def brute(filled, size, capacity):
    """The smallest sum that any placement of the next item can give, by trying every container and a new one."""
    inside = [[*filled[:k], f + size, *filled[k + 1 :]] for k, f in enumerate(filled) if f + size <= capacity]
    return min(squares(levels, capacity) for levels in [*inside, [*filled, size]])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_rule_against_brute_force(sizes):
    capacity, filled = 12, []
    for size, c in zip(sizes, sum_of_squares(np.array(sizes, dtype=np.int64), capacity).tolist()):
        best = brute(filled, size, capacity)
        filled = [*filled[:c], filled[c] + size, *filled[c + 1 :]] if c < len(filled) else [*filled, size]
        assert filled[c] <= capacity and squares(filled, capacity) == best


def test_rounds_end_when_none_is_settled(spark):
    # no two of these fit together, so that no container is ever full enough
    df = spark.createDataFrame([(k, 60) for k in range(60)], "id bigint, size bigint")
    assert pack(df, "id", "size", 100, group=10).select("container").distinct().count() == 60


def test_waste_is_small():
    sizes = np.sort(np.clip(np.random.default_rng(1).lognormal(5, 0.8, 5000).astype(int), 1, 2047))[::-1]
    assert sum_of_squares(sizes, 2048).max() + 1 <= 1.02 * sizes.sum() / 2048


@pytest.mark.parametrize("group", [100_000, 50])
def test_items_stay_whole(spark, group):
    sizes = [None, 0, 1, 99, 100, 101, 250, 300, -5, *[7 + k % 60 for k in range(400)], 33, 33]
    df = spark.createDataFrame([(k if k < 408 else 407, s, "x", 0) for k, s in enumerate(sizes)], "id bigint, size bigint, container string, piece int")
    out = pack(df, "id", "size", 100, group=group).toPandas()
    kept = [(i, s) for i, s, _, _ in ((r.id, r["size"], 0, 0) for r in df.collect()) if s is not None and s >= 0]
    assert out.n_tokens.sum() == sum(s for _, s in kept)
    assert (out.groupby("container").n_tokens.sum() <= 100).all()
    assert out[out["item"] == 6].n_tokens.tolist().count(100) == 2 and sorted(out[out["item"] == 6].n_tokens) == [50, 100, 100]
    assert sorted(out[out["item"] == 3].n_tokens) == [99] and sorted(out[out["item"] == 4].n_tokens) == [100]
    assert len(out) == len(kept) + 1 + 2 + 2
    assert out.container.nunique() <= 1.1 * sum(s for _, s in kept) / 100 + 3


def test_empty(spark):
    assert pack(spark.createDataFrame([], "id bigint, size bigint"), "id", "size", 100).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")
def test_tokens_against_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["", "Hello, world's  end\n\n naïve 123", "<|endoftext|>", "ünï " * 5000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.n for r in df.select(token_counts(F.col("t")).alias("n")).collect()] == [*[len(other.encode(t, add_special_tokens=False).ids) for t in texts], None]
